"""Near duplicates by bottom-k sketches of word shingles.

One hash function; a document's sketch holds the k least hashes of its set of shingles.  Documents of equal sets form a class with its
least id as representative, so exact copies cost one aggregation.  Between representatives:

1.  *Inverted lists.*  Of each sketch only the rarest retained values are indexed, rarest first, as many as a pair above the threshold
    cannot all differ in (exactly so where the sketch is the whole set, with those more that a larger partner's sketch may lack; else with
    five standard deviations to spare).  Values that one
    document alone retains use up places but need no list, so most documents have none.
2.  *Overlaps.*  A short list gives its pairs.  A long one gives each member's pairs with its hubs (the member of least id, one chosen by
    hash and the most typical one): lists of one group of copies share their hubs, and work is linear in the group.
3.  *Union-sketch estimation* drops pairs whose estimated Jaccard index lies far below the threshold.
4.  *Exact Jaccard* on the full sets, made anew from the texts of documents in candidate pairs alone, confirms links.
5.  Long lists of one hub whose members are not all in one component yet form a group.  Each member is written as its difference to the
    group's centre (the values that more than half of the members hold).  |a ^ b| = |da ^ db|, so members whose differences are small
    enough together are linked for certain and meet the one with the least; all others must share values of their differences, which
    are rare.  Inverted lists of those, rarest first with a bound by position, give the pairs that are left; no link between components
    is lost, and a group of copies with edits of their own costs about its size.

Components are found by star contraction; nothing but a few sums comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import graph

K = 64
SHORT = 8  # lists up to this length give all pairs


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document number, ascending distinct shingle hashes)."""
    for i, j in C.blocks(offsets):
        words, before = C.words_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k, s in enumerate(C.doc_shingles(words, before, shingle)):
            s = np.sort(s)
            yield i + k, s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def sketches(docs: DataFrame, shingle: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), h1, h2 (128-bit hash of the set), sketch (longs, the k least hashes, by unsigned order)."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = C.text_buffer(batch.column(1))
            n, h, sk = [], [], []
            for _, s in shingle_sets(raw, offs, shingle):
                n.append(len(s))
                h.append((s.sum(dtype=np.uint64), C.mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)) if len(s) else (0, 0))
                sk.append(s[:k])
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sk])]).astype(np.int32)
            both = np.array(h, np.uint64).reshape(-1, 2).view(np.int64)
            values = np.concatenate([*sk, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "n", "h1", "h2", "sketch"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch array<long>")


def _estimate(pairs: DataFrame, reps: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs whose Jaccard index may reach the threshold, judged by the k least values of the union of both sketches."""
    sk = reps.select("rep", "n", "sketch")
    joined = pairs.join(sk.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(sk.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for c in ("sa", "sb"):
                col = batch.column(c)
                o = col.offsets.to_numpy()
                lists.append((col.values.to_numpy().view(np.uint64), o))
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (v[o[i] : o[i + 1]] for v, o in lists)
                whole = na[i] <= k and nb[i] <= k
                both = np.sort(np.concatenate([x, y]))
                twice = both[1:] == both[:-1]
                if whole:
                    size, shared, slack = len(both) - int(twice.sum()), int(twice.sum()), 0.0
                else:
                    union = both[np.concatenate([[True], ~twice])]
                    size = min(k, len(union))
                    shared = int(np.count_nonzero(both[1:][twice] <= union[size - 1]))
                    slack = 4.5 * math.sqrt(least * (1 - least) / size)
                keep[i] = shared >= (least - slack) * size - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(need: DataFrame, docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, items): the full set, as packed ascending hashes, of each row whose id is in need."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = C.text_buffer(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), C.packed([s for _, s in shingle_sets(raw, offs, shingle)])], ["id", "items"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return C.likely(slim, need, "id").join(need, "id", "left_semi").mapInArrow(run, "id long, items binary")


def _unpacked(items: DataFrame) -> DataFrame:
    """(rep, key, items): sets as arrays; key tells apart rows that repeat an id."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in col])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*col, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["rep", "key", "items"])

    return items.select("id", F.xxhash64("items"), "items").mapInArrow(run, "rep long, key long, items array<long>")


def _between(groups: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, list[str]]:
    """Pairs (a, b), a < b, of members of one group and different components that may be linked, enough of them to join components; and
    the folders that they are read from.

    groups: g, m (members of the group), rep, n, component, away (outside the group's largest component); sets: rep, key, items.
    With s = (den + num) * |difference| - (den - num) * n, a and b are linked where s_a + s_b <= 2 * (den + num) * |shared differences|.
    """
    share = F.ceil(F.col("m") / 64).cast("int")  # a large group is dealt to many tasks; what belongs to the group goes to each
    salted = F.pmod(F.xxhash64("rep"), share.cast("long")).alias("salt")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), share.cast("long") - 1)).alias("salt")
    members, members_path = C.store(groups.join(sets, "rep").filter("size(items) = n"), "members")
    held = members.select("g", "m", F.explode("items").alias("value")).groupBy("g", "m", "value").agg(F.count("*").alias("c")).filter("2 * c > m")
    centre = held.groupBy("g", "m").agg(F.collect_list("value").alias("centre"))  # at most twice the mean set of the group
    centre = centre.select("g", "centre", everywhere)
    core = F.coalesce("centre", F.array().cast("array<long>"))
    delta = members.select("*", salted).join(centre, ["g", "salt"], "left").select("g", "m", "salt", "rep", "key", "n", "component", "away", F.concat(F.array_except("items", core), F.array_except(core, "items")).alias("d"))
    delta, delta_path = C.store(delta.withColumn("s", (den + num) * F.size("d").cast("long") - (den - num) * F.col("n")), "delta")
    least = delta.groupBy("g", "m").agg(F.min(F.struct("s", "rep", "component")).alias("least")).select("g", "least", everywhere)
    delta = delta.join(least, ["g", "salt"])
    ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    certain = delta.filter((F.col("s") + F.col("least.s") <= 0) & (F.col("component") != F.col("least.component"))).select(F.col("rep").alias("a"), F.col("least.rep").alias("b")).select(*ordered)

    who = ("g", "rep", "key", "n", "component", "away", "s")
    flat = delta.select(*who, F.col("least.s").alias("least"), F.explode("d").alias("value"))
    shared = flat.groupBy("g", "value").agg(F.count("*").alias("df"), F.max("away").alias("any")).filter("df > 1 and any").select("g", "value", "df")
    own = flat.join(shared, ["g", "value"]).groupBy(*who, "least").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))
    # of the values from here on, `rest` are left: no pair that first meets here can share more
    index = own.select(*who, "least", F.size("own").alias("size"), F.posexplode("own").alias("at", "x")).select(*who, "least", F.col("x.value").alias("value"), (F.col("size") - F.col("at")).alias("rest"))
    index, index_path = C.store(index.filter(2 * (den + num) * F.col("rest") >= F.col("s") + F.col("least")).drop("key", "least"), "differences")
    a = index.filter("away").select("g", "value", *(F.col(x).alias(x + "_a") for x in ("rep", "n", "component", "s", "rest")))
    b = index.select("g", "value", *(F.col(x).alias(x + "_b") for x in ("rep", "n", "component", "s", "rest")))
    need = F.col("s_a") + F.col("s_b")
    sizes = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    may = (a["g"] == b["g"]) & (a["value"] == b["value"]) & (F.col("component_a") != F.col("component_b")) & (need > 0) & (2 * (den + num) * F.least("rest_a", "rest_b") >= need) & sizes
    return certain.union(a.join(b, may).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).select(*ordered)).distinct(), [members_path, delta_path, index_path]


def _verify(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Links (a, b): pairs with den * intersection >= num * union on the full sets; and the folder of the sets."""
    # an id that is repeated has several sets: each may confirm
    items, path = C.store(_sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), docs, shingle, id_col, text_col), "sets")
    joined = pairs.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * shared >= num * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), path


def near_duplicates(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Links are pairs with den * |intersection| >= num * |union| of their shingle sets; fewer words than a shingle make one shingle; a
    document without words (null, empty or white text) has an empty set and no links.  component_id is the least id reachable;
    kept is doc_id = component_id.  Rows with a null id have a null component and are kept.  Rows that repeat an id are one document with
    several texts: linked with whatever one of them is linked with, and all of one component (rows without words stay by themselves).
    An empty table gives no rows; other columns are not read.
    """
    spark, least = C.gentle(docs.sparkSession), num / den
    full, full_path = C.store(sketches(docs, shingle, k, id_col, text_col), "sketches")
    # classes of equal sets: least ids by salt first, so that a class of any size is spread; a class has as many rows here as it has salts
    salted = F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int").alias("salt")
    rows, _ = C.store(full.select("doc_id", "n", "h1", "h2", salted), "rows")
    sound = rows.filter("n > 0 and doc_id is not null")
    parts = sound.groupBy("h1", "h2", "salt").agg(F.min("doc_id").alias("rep"))
    classes, _ = C.store(parts.groupBy("h1", "h2").agg(F.min("rep").alias("rep"), F.collect_list("salt").alias("salts")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"]).dropDuplicates(["doc_id", "h1", "h2"])
    reps, reps_path = C.store(reps.select(F.col("doc_id").alias("rep"), "n", "sketch"), "reps")
    C.discard(spark, full_path)
    # ids of several classes tie these together
    several = sound.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("one"), F.max(F.struct("h1", "h2")).alias("last")).filter("one <> last").select("doc_id")
    tied = sound.join(several, "doc_id", "left_semi").select("doc_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "rep"), ["h1", "h2"])
    least_of = tied.groupBy("doc_id").agg(F.min("rep").alias("a"))
    ties, ties_path = C.store(tied.join(least_of, "doc_id").select("a", F.col("rep").alias("b")).filter("a < b").distinct(), "ties")

    # values that two representatives retain, by rarity; values of one representative alone use up places
    sample = math.ceil(k * (1 - least)) + math.ceil(5 * math.sqrt(k * least * (1 - least))) + 1
    # the sketch of a linked partner, of n * den / num values at most, lacks what it holds beyond k
    lacking = F.greatest(F.lit(0), F.floor(F.col("n") * F.lit(den) / F.lit(num)) - k)
    places = F.when(F.col("n") <= k, F.least("n", F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)) + 1 + lacking)).otherwise(F.lit(sample))
    values = reps.select("rep", "n", places.cast("int").alias("places"), F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    mine = values.join(shared, "value").groupBy("rep", "n", "places", "size").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))  # at most k values a document
    left = F.greatest(F.lit(0), F.col("places") - (F.col("size") - F.size("own")))
    index = mine.select("rep", "n", (F.size("own") / F.col("size")).alias("central"), F.explode(F.slice("own", 1, left)).alias("x")).select("rep", "n", "central", F.col("x.value").alias("value"))
    index, index_path = C.store(index, "index")
    # hubs of a list: its least id, one chosen by hash, and the one with the largest share of retained values that others retain too
    hubs = (F.min("rep").alias("hub1"), F.min_by("rep", F.xxhash64("rep")).alias("hub2"), F.max_by("rep", F.struct("central", "rep")).alias("hub3"))
    lists, lists_path = C.store(index.groupBy("value").agg(F.count("*").alias("c"), *hubs).filter("c > 1"), "lists")
    C.release(spark)

    near = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    short = index.join(lists.filter(F.col("c") <= SHORT).select("value"), "value")
    members = index.join(lists.filter(F.col("c") > SHORT).select("value", "hub1", "hub2", "hub3"), "value")
    in_list = short.groupBy("value").agg(F.collect_list(F.struct("rep", "n")).alias("m"))  # at most SHORT
    pairs = in_list.select(F.explode("m").alias("p"), "m").select("p", F.explode("m").alias("q")).filter("p.rep < q.rep").select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb")).filter(near).select("a", "b")
    hubs = members.select(F.col("rep").alias("x"), F.explode(F.array_distinct(F.array("hub1", "hub2", "hub3"))).alias("y")).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # overlap: the number of lists in which a pair meets; each one is looked at once
    found, found_path = C.store(pairs.union(hubs).groupBy("a", "b").agg(F.count("*").alias("overlap")), "pairs")

    def confirm(p: DataFrame) -> DataFrame:
        kept, kept_path = C.store(_estimate(p.select("a", "b"), reps, k, least), "likely")
        confirmed, sets_path = _verify(kept, docs, shingle, num, den, id_col, text_col)
        confirmed, _ = C.store(confirmed.distinct(), "links")
        C.discard(spark, kept_path, sets_path)
        return confirmed

    links = confirm(found).union(ties)
    labels, labels_path = C.store(graph.components(links), "labels")
    C.release(spark)
    # long lists of one hub with members of several components
    named = members.select(F.col("hub1").alias("g"), "rep", "n").distinct().join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named, named_path = C.store(named, "named")
    sizes = named.groupBy("g", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("g").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("m"), F.count("*").alias("kinds")).filter("kinds > 1")
    groups, groups_path = C.store(named.join(main.select("g", "main", "m"), "g").select("g", "m", "rep", "n", "component", (F.col("component") != F.col("main")).alias("away")), "open")
    C.discard(spark, named_path, lists_path, index_path)
    sets, sets_path = C.store(_sets(groups.select(F.col("rep").alias("id")).distinct(), docs, shingle, id_col, text_col), "sets")
    p, between = _between(groups, _unpacked(sets), num, den)
    p, more_path = C.store(p.join(found, ["a", "b"], "left_anti"), "more")
    C.discard(spark, groups_path, sets_path, found_path, *between)
    if not p.isEmpty():
        more = confirm(p)
        if not more.isEmpty():
            C.discard(spark, labels_path)
            labels, labels_path = C.store(graph.components(links.union(more)), "labels")
    C.discard(spark, more_path, reps_path, ties_path)
    C.release(spark)
    # components are those of classes; rows find their class by its salts, and those without words do not look for any
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"), F.explode("salts").alias("salt"))
    placed = sound.join(named, ["h1", "h2", "salt"]).select("doc_id", "n", "component")
    out = placed.union(rows.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
