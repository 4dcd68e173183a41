"""Trimming, slugs, Unicode normal forms and provenance: the scalar base of everything else.

"Covered" white space is space, tab, line feed and carriage return, nothing else.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COVERED = " \t\n\r"
PROVENANCES = ("explicit_source", "structured_metadata", "parsed_description", "derived", "inferred", "unavailable")
TEXT = T.StructType([T.StructField("value", T.StringType()), T.StructField("provenance", T.StringType())])
NUMBER = T.StructType([T.StructField("value", T.IntegerType()), T.StructField("provenance", T.StringType())])


def row_type(fields: str) -> T.StructType:
    """A struct of string and int fields, without a session: ``a string, b int``."""
    kinds = {"string": T.StringType(), "int": T.IntegerType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])


def trim_covered(x: Column) -> Column:
    return F.btrim(x, F.lit(COVERED))


def identifier(x: Column) -> Column:
    """Trimmed and in lower case."""
    return F.lower(trim_covered(x))


def nullable_text(x: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(trim_covered(x), F.lit(""))


def company_name(x: Column) -> Column:
    return F.lower(F.regexp_replace(trim_covered(x), "[\t\n\r ]+", " "))


email = identifier


def is_slug(x: Column) -> Column:
    return x.rlike(r"\A[a-z0-9][a-z0-9._-]*\z")


def is_meaningful(x: Column) -> Column:
    """Has a character that is neither white space nor a format character."""
    return F.coalesce(x.rlike(r"(?U)[^\s\p{Cf}\x{1c}-\x{1f}]"), F.lit(False))


def is_usable_id(x: Column) -> Column:
    """A JSON value that is an integer or a string with content."""
    kind = F.schema_of_variant(x)
    return F.when(kind == "STRING", F.btrim(F.try_variant_get(x, "$", "string")) != "").otherwise(F.coalesce(kind == "BIGINT", F.lit(False)))


def is_https_url(x: Column) -> Column:
    return F.coalesce((F.lower(F.try_parse_url(x, F.lit("PROTOCOL"))) == "https") & (F.try_parse_url(x, F.lit("HOST")) != ""), F.lit(False))


def aware_timestamp(x: Column) -> Column:
    """The time of an ISO-8601 text with an offset; null for others, those without an offset among them."""
    return F.when(x.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})\z"), F.try_to_timestamp(x))


def through(fn, kind, x: Column, needed: Column) -> Column:
    """fn(x) in Python, for rows that need it alone: the others reach Python as nulls."""
    return fn(F.when(needed, x))


def _mapped(name: str, per_value):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else per_value(v), na_action="ignore")

    run.__name__ = name
    return run


_nfkc = _mapped("nfkc", lambda v: unicodedata.normalize("NFKC", v))
_casefold = _mapped("casefold", str.casefold)
_lookup = _mapped("lookup_key", lambda v: lookup_key_of(v))
_ASCII = r"\A[\x00-\x7f]*\z"


def nfkc(x: Column) -> Column:
    odd = ~x.rlike(_ASCII)
    return F.when(odd, through(_nfkc, "string", x, odd)).otherwise(x)


def casefold(x: Column) -> Column:
    odd = ~x.rlike(_ASCII)
    return F.when(odd, through(_casefold, "string", x, odd)).otherwise(F.lower(x))


def lookup_key_of(text: str) -> str:
    """NFKC, trimmed, runs of covered white space as one space, lower case."""
    parts = unicodedata.normalize("NFKC", text).strip(COVERED)
    for c in "\t\n\r":
        parts = parts.replace(c, " ")
    return " ".join(p for p in parts.split(" ") if p).lower()


def lookup_key(x: Column) -> Column:
    odd = ~x.rlike(_ASCII)
    plain = F.lower(F.regexp_replace(trim_covered(x), "[ \t\n\r]+", " "))
    return F.when(odd, through(_lookup, "string", x, odd)).otherwise(plain)


def field_text(x: Column) -> Column:
    """NFKC, trimmed, one final full stop dropped (but not one of several), trimmed again."""
    t = trim_covered(nfkc(x))
    return F.when(t.rlike(r"\.\z") & ~t.rlike(r"\.\.\z"), trim_covered(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(t)


def bind(x: Column, fn) -> Column:
    """fn(x) with x worked out once, however often fn names it."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def found(value: Column, provenance: str | Column) -> Column:
    """(value, provenance): a null value is always ``unavailable``."""
    p = F.lit(provenance) if isinstance(provenance, str) else provenance
    return F.struct(value.alias("value"), F.when(value.isNull(), F.lit("unavailable")).otherwise(p).alias("provenance"))


def groups(text: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that matches the whole text, '' where one is absent; null if it does not match.  One match a row."""
    whole = rf"\A(?:{pattern})\z"
    return F.when(text.rlike(whole), F.split(F.regexp_replace(text, whole, "\u0001".join(f"${i}" for i in range(1, n + 1))), "\u0001", -1))


def label_path(record: Column, *parts: Column) -> Column:
    return F.concat(record, F.lit("|"), F.concat_ws(".", *parts))
