"""Job titles to a canonical title and role family, by native expressions.

A title is cut into segments; each ends in an alias of a canonical title or not, and may hold words that make that doubtful.  The first
segment decides, unless a later one says something else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .primitives import bind, found

# Canonical titles with family and aliases, words that make a match doubtful, and words that point to a family.
TITLES = {
    "software-engineer": ("software_engineering", ["software engineer", "software developer", "backend engineer", "back end engineer", "frontend engineer", "front end engineer", "full stack engineer", "fullstack engineer"]),
    "security-engineer": ("security_engineering", ["security engineer"]),
    "research-engineer": ("research", ["research engineer"]),
    "research-scientist": ("research", ["research scientist"]),
    "engineering-manager": ("engineering_management", ["engineering manager"]),
    "engineering-director": ("engineering_management", ["director of engineering", "engineering director"]),
    "product-manager": ("product_management", ["product manager"]),
    "solutions-architect": ("solutions_architecture", ["solutions architect", "solution architect"]),
    "account-executive": ("sales", ["account executive"]),
}
BLOCKERS = frozenset(["recruiter", "sourcer", "manager", "director", "head", "vp", "president", "coordinator", "partner", "consultant", "analyst", "specialist", "intern", "assistant", "of", "for", "to", "and", "or", "&"])
ROLES = frozenset(["engineer", "engineers", "developer", "developers", "architect", "architects", "scientist", "scientists", "manager", "managers", "director", "directors", "executive", "executives", "recruiter", "recruiters", "sourcer", "sourcers", "coordinator", "coordinators", "partner", "partners", "consultant", "consultants", "analyst", "analysts", "specialist", "specialists", "intern", "interns", "assistant", "assistants", "counsel", "attorney", "attorneys", "designer", "designers", "researcher", "researchers", "head", "heads", "president", "presidents", "vp", "vps"])
LAST_ROLES = ROLES | {"lead", "leads"}
SIGNALS = {
    "software_engineering": ["software", "backend", "back end", "frontend", "front end", "fullstack", "full stack"],
    "security_engineering": ["security"],
    "engineering_management": ["management"],
    "research": ["research"],
    "product_management": ["product"],
    "solutions_architecture": ["solution", "solutions", "architecture"],
    "sales": ["account", "sales"],
}
_DASHES = "‐‑‒–—―−"

_WHOLE = r"(?:^| )(?:{})(?= |$)"


def _any_of(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


#: Of a segment as tokens with one space between: its alias at the end, foreign signals by family, doubtful words, and a role at the end.
_ENDING = rf"(?:^| )({_any_of(a for _, aliases in TITLES.values() for a in aliases)})$"
_FOREIGN = {family: _WHOLE.format(_any_of(w for f, signals in SIGNALS.items() if f != family for w in signals)) for family in sorted({f for f, _ in TITLES.values()})}
_DOUBTFUL = _WHOLE.format(_any_of(BLOCKERS | ROLES))
_ROLE = rf"(?:^| )(?:{_any_of(LAST_ROLES)})(?: (?:i|ii|iii|iv|v|[1-9][0-9]?))?$"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))


def _plain(title: Column) -> Column:
    """The title in lower-case ASCII, as far as its characters have a place in one."""
    x = F.translate(F.translate(title, _WIDE, "".join(map(chr, range(0x21, 0x7F)))), _DASHES, "-" * len(_DASHES))
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[\u2028\u2029]", "|"), r"\p{Zs}", " "), "[\t\r\n]", " ")
    return F.when(~x.rlike(r"[^\x00-\x7F]"), F.lower(x)).otherwise("\x00")


def _read(segment: Column) -> Column:
    """struct(kind, name) of a segment: match, doubt, role or none."""
    name, family = F.lit(None).cast("string"), F.lit(None).cast("string")
    alias = F.regexp_extract(segment, _ENDING, 1)
    before = F.substring(segment, F.lit(1), F.length(segment) - F.length(alias))
    for title, (group, aliases) in TITLES.items():
        name, family = F.when(alias.isin(*aliases), title).otherwise(name), F.when(alias.isin(*aliases), group).otherwise(family)
    foreign = F.lit(False)
    for group, pattern in _FOREIGN.items():
        foreign = foreign | ((family == group) & F.btrim(before).rlike(pattern))
    kind = F.when(alias == "", F.when(segment.rlike(_ROLE), "role").otherwise("none")).when(F.coalesce(foreign, F.lit(False)) | F.btrim(before).rlike(_DOUBTFUL), "doubt").otherwise("match")
    return F.struct(kind.alias("kind"), name.alias("name"), family.alias("family"))


def classify_title(title: Column) -> Column:
    """struct(canonical_title, role_family, outcome), the first two struct(value, provenance)."""

    def decide(text: Column) -> Column:
        bare = F.regexp_replace(text, r"^ *\[ *expression +of +interest *\]", "")
        parts = F.transform(F.split(bare, r"[,;:|/@()\[\]{}]|(?<= )-(?= )"), lambda s: F.array_join(F.regexp_extract_all(s, F.lit("([a-z0-9]+|&)"), F.lit(1)), " "))
        return bind(F.transform(F.filter(parts, lambda s: s != ""), _read), judge)

    def judge(r: Column) -> Column:
        first, later = F.get(r, F.lit(0)), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
        kind = first["kind"]
        several = F.exists(later, lambda x: x["kind"].isin("match", "doubt"))
        unsure = F.exists(later, lambda x: x["kind"].isin("doubt", "role") | ((x["kind"] == "match") & (x["name"] != first["name"])))
        outcome = F.when(F.size(r) == 0, "unsupported").when((kind == "doubt") | ((kind != "match") & several), "ambiguous").when(kind != "match", "unsupported").when(unsure, "ambiguous").otherwise("matched")
        return F.struct(outcome.alias("outcome"), first["name"].alias("name"), first["family"].alias("family"))

    def answer(text: Column) -> Column:
        none = F.lit(None).cast("string")
        fixed = lambda o: F.struct(F.lit(o).alias("outcome"), none.alias("name"), none.alias("family"))
        return F.when(text.isNull(), fixed("no_title")).when(~text.rlike(r"^[a-z0-9 ,;:|/@()\[\]{}&+-]*$"), fixed("unsupported")).when(F.btrim(text) == "", fixed("no_title")).otherwise(decide(text))

    def shape(r: Column) -> Column:
        hit = r["outcome"] == "matched"
        field = lambda v: found(F.when(hit, v), "inferred")
        return F.struct(field(r["name"]).alias("canonical_title"), field(r["family"]).alias("role_family"), r["outcome"].alias("outcome"))

    return bind(bind(F.when(title.isNotNull(), _plain(title)), answer), shape)
