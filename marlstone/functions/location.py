"""Location text to (city, state, country, postal_code), by native expressions.  A city is never claimed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .primitives import bind, field_text, found, groups, trim_covered

# States, those whose code is also a country's, countries and their other names, markers and empty phrases.
STATES = ["AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC"]
COLLIDING = ["AL", "AR", "AZ", "CA", "CO", "DE", "GA", "ID", "IL", "IN", "KY", "LA", "MA", "MD", "ME", "MN", "MO", "MS", "MT", "NC", "NE", "PA", "SC", "SD", "TN", "VA"]
COUNTRIES = {
    "United States": ("united states", "us", "u.s.", "u.s", "u.s.a.", "u.s.a", "usa"),
    "United Kingdom": ("united kingdom", "uk"),
    "Canada": ("canada",),
    "Australia": ("australia",),
    "Ireland": ("ireland",),
    "Germany": ("germany",),
    "France": ("france",),
    "India": ("india",),
    "Singapore": ("singapore",),
    "Netherlands": ("netherlands",),
}
MARKERS = ("remote", "hybrid", "on-site", "on site", "onsite")
NOWHERE = ("multiple locations", "various locations", "worldwide", "various", "multiple", "nationwide", "global")

_S = r"[\t\n\r ]"
_STATE = rf"{'|'.join(s for s in STATES if s != 'DC')}|DC|D\.C\.?"
_COUNTRY = "|".join(n.replace(".", r"\.").replace(" ", f"{_S}+") for n in sorted((n for names in COUNTRIES.values() for n in names), key=len, reverse=True))
_MARK = "|".join(MARKERS)
_GEO = r"[A-Za-z][A-Za-z .'\-]*"
_BEFORE = rf"(?i)(?:({_MARK})(?:{_S}*,{_S}*|{_S}+-{_S}+))?"
_AFTER = rf"(?:{_S}+\({_S}*({_MARK}){_S}*\))?"
_COMMA = rf"{_S}*,{_S}*"
#: In the order in which they are tried; groups: marker, then those named, then marker.
FORMS = {
    "country": (rf"{_BEFORE}({_COUNTRY}){_AFTER}", ("country",)),
    "state": (rf"{_BEFORE}({_GEO}){_COMMA}({_STATE}){_AFTER}", ("geo", "state")),
    "zip": (rf"{_BEFORE}({_GEO}){_COMMA}({_STATE}){_S}+([0-9]{{5}}(?:-[0-9]{{4}})?){_AFTER}", ("geo", "state", "zip")),
    "geo_country": (rf"{_BEFORE}({_GEO}){_COMMA}({_COUNTRY}){_AFTER}", ("geo", "country")),
    "region_country": (rf"{_BEFORE}({_GEO}){_COMMA}({_GEO}){_COMMA}({_COUNTRY}){_AFTER}", ("geo", "region", "country")),
}
_NAMES = ("before", "geo", "region", "state", "zip", "country", "after")


def _collapsed(x: Column) -> Column:
    return F.lower(F.regexp_replace(trim_covered(x), f"{_S}+", " "))


def _country(x: Column) -> Column:
    out, key = F.lit(None).cast("string"), _collapsed(x)
    for name, others in COUNTRIES.items():
        out = F.when(key.isin(*others), name).otherwise(out)
    return out


def _state(x: Column) -> Column:
    t = trim_covered(x)
    return F.when(t.rlike(rf"(?i)\A(?:{_STATE})\z"), F.upper(F.replace(t, F.lit("."), F.lit(""))))


def _doubtful(x: Column) -> Column:
    """A span that is dropped must not say more than a place."""
    word = rf"(?i)(?<![A-Za-z])(?:or|and|not|except|excluding|excluded|{_MARK})(?![A-Za-z])"
    return x.rlike(word) | x.rlike("[/;|]") | _collapsed(x).isin(*NOWHERE) | _country(x).isNotNull()


def classify_location(x: Column) -> Column:
    """struct(city, state, country, postal_code), each struct(value, provenance)."""
    def read(text: Column) -> Column:
        parts = None
        for form, (pattern, names) in FORMS.items():
            order = ("before", *names, "after")
            got = groups(text, pattern, len(order))
            cells = [F.lit(form).alias("form")] + [(F.get(got, F.lit(order.index(n))) if n in order else F.lit("")).alias(n) for n in _NAMES]
            this = F.when(got.isNotNull(), F.struct(*cells))
            parts = this if parts is None else F.coalesce(parts, this)
        return parts

    def known(p: Column) -> Column:
        return F.struct(*[p[n].alias(n) for n in ("form", "before", "after", "geo", "zip")], p["region"].alias("region_text"), _state(p["state"]).alias("state"), _country(p["country"]).alias("country"), _state(p["region"]).alias("region"))

    def decide(p: Column) -> Column:
        form, state, country, region = p["form"], p["state"], p["country"], p["region"]
        us = country == "United States"
        sound = ~((p["before"] != "") & (p["after"] != "")) & ~((p["geo"] != "") & _doubtful(p["geo"])) & ~((p["region_text"] != "") & region.isNull() & _doubtful(p["region_text"]))
        sound = sound & ~((form == "state") & state.isin(*COLLIDING)) & ~((form == "region_country") & (us != region.isNotNull()))
        inferred = form.isin("state", "zip")
        use = lambda c: F.when(sound, c)
        return F.struct(
            found(F.lit(None).cast("string"), "unavailable").alias("city"),
            found(use(F.coalesce(state, region)), "parsed_description").alias("state"),
            found(use(F.when(inferred, "United States").otherwise(country)), F.when(inferred, "inferred").otherwise("parsed_description")).alias("country"),
            found(use(F.nullif(p["zip"], F.lit(""))), "parsed_description").alias("postal_code"),
        )

    nothing = found(F.lit(None).cast("string"), "unavailable")
    empty = F.struct(*[nothing.alias(n) for n in ("city", "state", "country", "postal_code")])
    return F.coalesce(bind(field_text(x), lambda t: bind(read(t), lambda p: F.when(p.isNotNull(), bind(known(p), decide)))), empty)
