"""Checks, uniqueness, foreign keys and set relations: what a database would enforce, as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trimmed_or_null(x: Column) -> Column:
    """Null, or text with content and no covered white space around it."""
    return x.isNull() | ((x != "") & (x == F.btrim(x, F.lit(" \t\n\r"))))


def one_of(x: Column, *values: str) -> Column:
    return x.isNull() | x.isin(*values)


def ordered(low: Column, high: Column) -> Column:
    return low.isNull() | high.isNull() | (low <= high)


def both_or_neither(a: Column, b: Column) -> Column:
    return a.isNull() == b.isNull()


def if_and_only_if(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) == F.coalesce(b, F.lit(False))


def json_shape(x: Column, shape: str) -> Column:
    """shape: object or array."""
    return x.isNull() | F.startswith(F.schema_of_variant(F.try_parse_json(x)), F.lit(shape.upper()))


def rejects(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with the names of all that they break.  As in SQL, a check of unknown value holds."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in sorted(checks.items())]), lambda n: n.isNotNull())
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def accept(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    return df.filter(~F.exists(F.array(*[~F.coalesce(c, F.lit(True)) for c in checks.values()]), lambda x: x))


def duplicates(df: DataFrame, keys: list[Column], where: Column | None = None) -> DataFrame:
    """Keys held by two rows or more, among those where a condition holds and no key is null."""
    named = [k.alias(f"key{i}") for i, k in enumerate(keys)]
    rows = (df.filter(where) if where is not None else df).select(*named).dropna()
    return rows.groupBy(*rows.columns).count().filter("count > 1")


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def set_null(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    gone = deleted.select(key, F.lit(True).alias("_gone")).distinct()
    return children.join(gone, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone").select(*children.columns)


def restricted(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Deleted parents that still have children: must be empty."""
    return deleted.select(key).distinct().join(children, key, "left_semi")


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def has_duplicates(a: Column) -> Column:
    return F.size(F.array_distinct(a)) < F.size(a)


def associated(raw: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings whose raw row is missing, says something else, is dealt with already or belongs to an occurrence: must be empty.

    raw has raw_id, provider, source, content_hash, fetched_at, key_id, status and occurrence_id.
    """
    cols = ["provider", "source", "content_hash", "fetched_at", "key_id"]
    other = raw.select("raw_id", "status", "occurrence_id", *[F.col(c).alias(f"raw_{c}") for c in cols])
    differs = ~F.col("status").eqNullSafe(F.lit("fetched")) | F.col("occurrence_id").isNotNull()
    for c in cols:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"raw_{c}"))
    return postings.join(other, "raw_id", "left").filter(differs).select(*postings.columns)


def owned(rows: DataFrame, owner: str, user, key: str | None = None, value=None) -> DataFrame:
    """The rows of a user; with key, the one of that key."""
    out = rows.filter(F.col(owner) == F.lit(user))
    return out if key is None else out.filter(F.col(key) == F.lit(value))


def allowed_only(x: Column, names: list[str]) -> Column:
    """A JSON object (text) with the named fields alone, in order of name; null if it is no object."""
    fields = F.from_json(x, "map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: k.isin(*names))
    parts = F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(F.to_json(F.array(k)), F.lit(":"), F.to_json(F.element_at(kept, k))))
    pairs = F.transform(parts, lambda p: F.regexp_replace(p, r'^\[("(?:[^"\\]|\\.)*")\]:', "$1:"))
    return F.when(F.startswith(F.ltrim(x), F.lit("{")) & fields.isNotNull(), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def patched(rows: DataFrame, patches: DataFrame, key: str, allowed: list[str], domains: dict[str, list[str]] | None = None) -> DataFrame:
    """rows with the fields of patches; a field that may not change, or a value outside its domain, is an error.

    A null in patches leaves the field as it is; fields named in the array column ``cleared`` of patches become null.
    """
    fields = [c for c in patches.columns if c not in (key, "cleared")]
    if odd := sorted(set(fields) - set(allowed)):
        raise ValueError(f"fields that cannot be changed: {odd}")
    value = {c: F.col(c) for c in fields}
    for c, values in (domains or {}).items():
        if c in value:
            wrong = F.raise_error(F.concat(F.lit(f"{c} cannot be "), F.col(c).cast("string"))).cast(patches.schema[c].dataType)
            value[c] = F.when(F.col(c).isNull() | F.col(c).isin(*values), F.col(c)).otherwise(wrong)
    cleared = F.col("cleared") if "cleared" in patches.columns else F.array().cast("array<string>")
    bad = F.array_except(cleared, F.array(*[F.lit(a) for a in allowed]))
    sound = F.when(F.size(bad) > 0, F.raise_error(F.lit("a field that cannot be changed is cleared")).cast("array<string>")).otherwise(cleared)
    p = patches.select(key, sound.alias("_cleared"), *[v.alias(f"_{c}") for c, v in value.items()])
    gone = lambda c: F.coalesce(F.array_contains("_cleared", c), F.lit(False))
    new = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in value else F.col(c)
    return rows.join(p, key, "left").select(*[F.when(~gone(c), new(c)).alias(c) if c in allowed else F.col(c) for c in rows.columns])
