"""Connected components by alternating large-star and small-star steps, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); the component is its least node.  Self-loops and repeats are allowed."""
    spark, old = edges.sparkSession, None
    now, path = C.store(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    state = None
    while True:
        # large star: the larger neighbours of a node go to its least neighbour
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new, new_path = C.store(small.filter("a <> b").distinct(), "edges")
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if old:
            C.discard(spark, old)
        old, now = path, new
        path = new_path
        if mark == state:
            break
        state = mark
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
