"""Salary text to (minimum, maximum, currency, period), by native expressions.

The whole field must read as one of five forms, with at least one anchor: a label, a currency code or a symbol.  Any doubt about a
part leaves that part unavailable.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .primitives import bind, field_text, found, groups

# Labels, currencies and what period words mean; periods that are known but not supported void the amounts.
LABELS = ("salary", "base salary", "base pay", "pay rate", "pay")
CODES = ("USD", "CAD", "AUD", "GBP", "EUR")
SYMBOL_CODES = {"$": ("USD", "CAD", "AUD"), "£": ("GBP",), "€": ("EUR",)}
PERIODS = {
    "hourly": ("hour", "hourly", "hr", "/hr", "per hour"),
    "daily": ("day", "daily", "/day", "per day"),
    "monthly": ("month", "monthly", "mo", "/mo", "per month"),
    "annual": ("year", "yearly", "annual", "annually", "yr", "/yr", "/year", "per year"),
}
PERIOD_WORDS = ("hour", "hourly", "hr", "day", "daily", "month", "monthly", "mo", "year", "yearly", "annual", "annually", "yr", "week", "weekly", "biweekly", "bi-weekly", "fortnight", "fortnightly", "semi-monthly", "semimonthly")
LARGEST = 2**31 - 1

_S = r"[\t\n\r ]"
_LABEL = "|".join(w.replace(" ", f"{_S}+") for w in sorted(LABELS, key=len, reverse=True))
_HEAD = rf"(?iu)(?:({_LABEL})(?::{_S}*|{_S}+))?(?:({'|'.join(CODES)}){_S}+)?"
_AMOUNT = rf"(-)?([$£€])?{_S}*([0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?k?)"
_TAIL = rf"(?:{_S}+({'|'.join(CODES)}))?(?:{_S}*(/[a-z]+)|{_S}+((?:{'|'.join(map(re.escape, PERIOD_WORDS))})|per{_S}+[a-z]+))?"
#: Form: pattern, and its groups in order.
FORMS = {
    "single": (rf"{_HEAD}{_AMOUNT}(\+)?{_TAIL}", "label code sign sym num plus code2 slash word"),
    "upper": (rf"{_HEAD}(?:up{_S}+to|up-to){_S}+{_AMOUNT}{_TAIL}", "label code sign sym num code2 slash word"),
    "hyphen": (rf"{_HEAD}{_AMOUNT}{_S}*-{_S}*{_AMOUNT}{_TAIL}", "label code sign sym num sign2 sym2 num2 code2 slash word"),
    "to": (rf"{_HEAD}{_AMOUNT}{_S}+to{_S}+{_AMOUNT}{_TAIL}", "label code sign sym num sign2 sym2 num2 code2 slash word"),
    "between": (rf"{_HEAD}between{_S}+{_AMOUNT}{_S}+and{_S}+{_AMOUNT}{_TAIL}", "label code sign sym num sign2 sym2 num2 code2 slash word"),
}
_NAMES = ("label", "code", "sign", "sym", "num", "plus", "sign2", "sym2", "num2", "code2", "slash", "word")


#: What only one form can hold, so that one pattern is tried for a text; the rest can be a single amount alone.
_HINTS = {
    "between": rf"(?iu)between{_S}",
    "upper": rf"(?iu)up(?:{_S}+|-)to{_S}",
    "to": rf"(?iu){_S}to{_S}",
    "hyphen": rf"(?iu)[0-9k]{_S}*-{_S}*-?[$£€]?{_S}*[0-9]",
    "single": "[0-9]",
}


def _parts(text: Column) -> Column:
    """struct of the form and its groups; null if the form does not fit."""
    out = None
    for form, hint in _HINTS.items():
        pattern, order = FORMS[form]
        names = order.split()
        got = groups(text, pattern, len(names))
        cells = lambda g: F.struct(F.lit(form).alias("form"), *((F.get(g, F.lit(names.index(n))) if n in names else F.lit("")).alias(n) for n in _NAMES))  # noqa: E731,B023
        this = bind(got, lambda g: F.when(g.isNotNull(), cells(g)))  # noqa: B023
        out = F.when(text.rlike(hint), this) if out is None else out.when(text.rlike(hint), this)
    return out


def _amount(num: Column, sign: Column) -> Column:
    """The number, null if it is signed, ill grouped, not whole or too large."""
    sound = num.rlike(r"(?i)\A(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.00)?k?\z") & (sign == "")
    value = F.try_to_number(F.regexp_replace(F.regexp_replace(num, r"\.00", ""), "[^0-9]", ""), F.lit("9" * 38)) * F.when(num.rlike(r"(?i)k\z"), 1000).otherwise(1)
    return F.when(sound & (value <= LARGEST), value.cast("int"))


def classify_salary(x: Column) -> Column:
    """struct(minimum, maximum, currency, period), each struct(value, provenance)."""

    def read(p: Column) -> Column:
        """The numbers and codes of the parts, each once."""
        shared = p["num2"].rlike(r"(?i)k\z") & ~p["num"].rlike(r"(?i)k\z")
        code, code2 = F.upper(p["code"]), F.upper(p["code2"])
        return F.struct(
            p["form"].alias("form"),
            p["plus"].alias("plus"),
            ((p["label"] != "") | (p["code"] != "") | (p["code2"] != "") | (p["sym"] != "") | (p["sym2"] != "")).alias("anchored"),
            bind(_amount(p["num"], p["sign"]).cast("long") * F.when(shared, 1000).otherwise(1), lambda n: F.when(n <= LARGEST, n.cast("int"))).alias("first"),
            _amount(p["num2"], p["sign2"]).alias("second"),
            (p["num2"] != "").alias("ranged"),
            F.lower(F.regexp_replace(F.concat(p["slash"], p["word"]), f"{_S}+", " ")).alias("word"),
            F.when(code == "", code2).otherwise(code).alias("code"),
            F.when(p["sym"] == "", p["sym2"]).otherwise(p["sym"]).alias("sym"),
            (((code != "") & (code2 != "") & (code != code2)) | ((p["sym"] != "") & (p["sym2"] != "") & (p["sym"] != p["sym2"]))).alias("clash"),
        )

    def decide(p: Column) -> Column:
        first, second, ranged, word, one_code, one_sym, clash = (p[n] for n in ("first", "second", "ranged", "word", "code", "sym", "clash"))
        sound = first.isNotNull() & second.isNotNull() & (first <= second)
        none = F.lit(None).cast("int")
        low = F.when(ranged, F.when(sound, first)).when(p["form"] == "upper", none).otherwise(first)
        high = F.when(ranged, F.when(sound, second)).when(p["plus"] != "", none).otherwise(first)
        period = None
        for name, words in PERIODS.items():
            period = F.when(word.isin(*words), name) if period is None else period.when(word.isin(*words), name)
        void = (word != "") & period.isNull()
        fits = F.lit(False)
        alone = F.lit(None).cast("string")
        for sym, codes in SYMBOL_CODES.items():
            fits = fits | ((one_sym == sym) & one_code.isin(*codes))
            if len(codes) == 1:
                alone = F.when(one_sym == sym, codes[0]).otherwise(alone)
        currency = F.when(~clash, F.when(one_code == "", alone).when((one_sym == "") | fits, one_code))
        use = lambda c: F.when(p["anchored"], c)
        return F.struct(
            found(use(F.when(~void, low)), "parsed_description").alias("minimum"),
            found(use(F.when(~void, high)), "parsed_description").alias("maximum"),
            found(use(currency), "parsed_description").alias("currency"),
            found(use(period), "parsed_description").alias("period"),
        )

    nothing = lambda kind: found(F.lit(None).cast(kind), "unavailable")
    empty = F.struct(nothing("int").alias("minimum"), nothing("int").alias("maximum"), nothing("string").alias("currency"), nothing("string").alias("period"))
    return F.coalesce(bind(field_text(x), lambda t: bind(_parts(t), lambda p: F.when(p.isNotNull(), bind(read(p), decide)))), empty)
