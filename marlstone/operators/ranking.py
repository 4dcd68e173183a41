"""Order-dependent operators: latest, first, top-k, neighbours, running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The row of greatest (at, tie) of each key, by an aggregate: a large key is one row a task before the shuffle."""
    rest = [c for c in df.columns if c not in (key, at, tie)]
    return df.groupBy(key).agg(F.max(F.struct(at, tie, *rest)).alias("r")).select(key, "r.*").select(*df.columns)


def first_writers(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in (key, seq)]
    return df.groupBy(key).agg(F.min(F.struct(seq, *rest)).alias("r")).select(key, "r.*").select(*df.columns)


def top_k(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k of each key (Spark keeps k a key and task before the shuffle)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def newest_first(df: DataFrame, key: str, at: str, tie: str, where: Column | None = None) -> DataFrame:
    """Rows (of those where a condition holds) with their place in the history of their key, the newest at 1; equal times by tie, greatest first."""
    rows = df if where is None else df.filter(where)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))).cast("long"))


def distinct_first(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The first k different values of each key, as text, in order of text."""
    once = df.select(key, F.col(value).cast("string").alias(value)).filter(F.col(value).isNotNull()).distinct()
    return top_k(once, key, [F.col(value)], k)


def children_in_order(df: DataFrame, parent: str, at: str, id_col: str, value: str) -> DataFrame:
    return df.groupBy(parent).agg(F.transform(F.sort_array(F.collect_list(F.struct(at, id_col, value))), lambda x: x[value]).alias("children"))


def representative(df: DataFrame, id_col: str) -> DataFrame:
    """The row of least id, ids compared as text: "10" comes before "9"."""
    return df.agg(F.min_by(F.struct(*df.columns), F.col(id_col).cast("string")).alias("r")).select("r.*")


def within_budget(df: DataFrame, by: str, order: str, size: str, budget: int, *, spans: int = 64) -> DataFrame:
    """Rows with the running sum of sizes, and whether it is still within the budget; order is a number, without repeats.

    The rows of a key are dealt to spans of its range of order: sums of spans before a row's, and a running sum in its span, so that a
    key of any size is worked on by many tasks.
    """
    ends = df.groupBy(by).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    span = F.floor((F.col(order) - F.col("_lo")) * F.lit(spans) / (F.col("_hi") - F.col("_lo") + 1)).cast("int")
    dealt = df.join(ends, by).withColumn("_span", span)
    total = dealt.groupBy(by, "_span").agg(F.sum(size).alias("_sum"))
    before = total.withColumn("_before", F.sum("_sum").over(Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")  # at most spans rows a key
    own = F.sum(size).over(Window.partitionBy(by, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.join(before, [by, "_span"]).withColumn("used", F.coalesce("_before", F.lit(0)) + own)
    return out.withColumn("within", F.col("used") <= budget).select(*df.columns, "used", "within")


def collapse_blanks(lines: Column) -> Column:
    """An array of lines with runs of blank ones as one."""
    return F.filter(lines, lambda x, i: (F.btrim(x) != "") | (i == 0) | (F.btrim(F.get(lines, i - 1)) != ""))


def nearest(positions: Column, at: Column, window: int) -> Column:
    """The members of an array of positions nearest to one, all of equal distance, none beyond the window."""
    far = F.filter(positions, lambda p: F.abs(p - at) <= window)
    least = F.array_min(F.transform(far, lambda p: F.abs(p - at)))
    return F.filter(far, lambda p: F.abs(p - at) == least)
