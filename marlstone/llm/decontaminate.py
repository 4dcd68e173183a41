"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item of m shingles is compared with all windows of m successive shingles of each document, and with the whole of a document
that has fewer.  Shingles are five words (in lower case,
ASCII punctuation as space);
a shingle weighs ln(1 + items / items that hold it), counted over the whole benchmark.  Windows without any shingle of the benchmark have similarity 0 and are passed
over; all others get a 128-bit SimHash.  The index holds, for each of 8 blocks of 16 bits, every value within 3 bits of an item's
block: two fingerprints within 31 bits agree to 3 bits in some block, so every item within that radius is found.  Exact weighted
Jaccard similarity (sum of least over sum of greatest weights, with multiplicity) verifies candidates.

Items are taken in passes of bounded size, each broadcast: documents are read once a pass.  The counts of shingles that two or more items
hold go with each pass, as windows may hold those of other passes; they alone grow with the benchmark, by 16 bytes a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS, BLOCKS, RADIUS = 128, 8, 31
PASS_BYTES = 1 << 26  # of packed shingles that a pass is meant to hold
_MASKS = np.array([0] + [sum(1 << b for b in c) for n in (1, 2, 3) for c in combinations(range(16), n)], np.uint16)  # within RADIUS // BLOCKS bits
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 32


def folded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case, ASCII punctuation as space: case and punctuation hide no item."""
    if (raw >= 128).any():
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace").lower().encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
    return _PLAIN[raw], offsets


def _signs(h: np.ndarray) -> np.ndarray:
    """[shingles, BITS] of -1 and 1."""
    both = np.stack([C.mix(h), C.mix(h ^ np.uint64(0xA0761D6478BD642F))], 1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


class Benchmark:
    """Items of one pass: their shingles, weights, fingerprints and the block index."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], n_items: int, df_keys: np.ndarray, df: np.ndarray):
        self.ids, self.n_items, self.df_keys, self.df = ids, n_items, df_keys, df
        self.sets = [np.sort(s) for s in sets]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.keys = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.prints = np.stack([self.fingerprint(_signs(s) * self.weight(s)[:, None]) for s in sets]) if sets else np.zeros((0, 16), np.uint8)
        blocks = np.ascontiguousarray(self.prints).view(np.uint16)
        self.index = []
        for b in range(BLOCKS if sets else 0):
            near = (blocks[:, b][:, None] ^ _MASKS[None]).ravel()
            owner = np.repeat(np.arange(len(ids), dtype=np.int32), len(_MASKS))
            order = np.argsort(near, kind="stable")
            self.index.append((np.searchsorted(near[order], np.arange(65537)), owner[order]))

    def weight(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.df_keys, h), max(0, len(self.df_keys) - 1))
        df = np.where(self.df_keys[at] == h, self.df[at], 1) if len(self.df_keys) else np.ones(len(h))
        return np.log1p(self.n_items / df)

    @staticmethod
    def fingerprint(signed: np.ndarray) -> np.ndarray:
        return np.packbits(signed.sum(0) > 0)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Whether each shingle is one of the benchmark."""
        out = self.table[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            where = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            out[at] = self.keys[where] == h[at]
        return out

    def similarity(self, window: np.ndarray, item: int) -> float:
        keys, back = np.unique(np.concatenate([window, self.sets[item]]), return_inverse=True)
        n = len(window)
        a, b, w = np.bincount(back[:n], minlength=len(keys)), np.bincount(back[n:], minlength=len(keys)), self.weight(keys)
        return float((np.minimum(a, b) * w).sum() / (np.maximum(a, b) * w).sum())

    def matches(self, h: np.ndarray, hit: np.ndarray, least: float) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, Hamming distance, first shingle, shingles) of the best window of each item found in a document."""
        best: dict[int, tuple] = {}
        for m in np.unique(self.size).tolist():
            if m > len(h) or not m:
                continue  # larger items follow below
            upto = np.concatenate([[0], np.cumsum(hit)])
            starts = np.flatnonzero(upto[m:] > upto[:-m])
            for part in np.array_split(starts, max(1, len(starts) // 4096)):
                # windows that overlap are summed together, from the first shingle of the part to the last
                if not len(part):
                    continue
                for run in np.split(part, np.flatnonzero(np.diff(part) > m) + 1):
                    lo, hi = int(run[0]), int(run[-1]) + m
                    signed = _signs(h[lo:hi]) * self.weight(h[lo:hi])[:, None]
                    sums = np.concatenate([np.zeros((1, BITS)), np.cumsum(signed, 0)])
                    prints = np.packbits(sums[run - lo + m] - sums[run - lo] > 1e-9, axis=1)
                    self._candidates(h, run, prints, m, self.size == m, least, best)
        if (self.size > len(h)).any() and hit.any():
            whole = self.fingerprint(_signs(h) * self.weight(h)[:, None])
            self._candidates(h, np.zeros(1, np.int64), whole[None], len(h), self.size > len(h), least, best)
        return [(i, *b) for i, b in sorted(best.items())]

    def _candidates(self, h: np.ndarray, run: np.ndarray, prints: np.ndarray, m: int, among: np.ndarray, least: float, best: dict) -> None:
        blocks, found = np.ascontiguousarray(prints).view(np.uint16), []
        for b in range(BLOCKS):
            at, owner = self.index[b]
            lo, hi = at[blocks[:, b].astype(np.int64)], at[blocks[:, b].astype(np.int64) + 1]
            n = hi - lo
            w = np.repeat(np.arange(len(run)), n)
            items = owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            own = among[items]
            found.append(w[own] * len(self.ids) + items[own])
        pairs = np.unique(np.concatenate(found))
        w, items = pairs // len(self.ids), pairs % len(self.ids)
        far = _ONES[prints[w] ^ self.prints[items]].sum(1)
        for k in np.flatnonzero(far <= RADIUS).tolist():
            item, start = int(items[k]), int(run[w[k]])
            s = self.similarity(h[start : start + m], item)
            if s >= least - 1e-9 and (item not in best or s > best[item][0]):
                best[item] = (s, int(far[k]), start, m)


def benchmark_passes(items: DataFrame, shingle: int, items_per_pass: int, id_col: str, text_col: str) -> Iterator[Benchmark]:
    """Items in passes of at most items_per_pass; null ids and items without words are left out (nothing can be similar to them)."""
    spark = C.gentle(items.sparkSession)

    @C.tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = C.text_buffer(batch.column(1))
            words, before = C.words_of(*folded(raw, offs))
            yield pa.RecordBatch.from_arrays([batch.column(0), C.packed(C.doc_shingles(words, before, shingle))], ["id", "items"])

    slim = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull())
    rows, _ = C.store(slim.mapInArrow(sets, "id long, items binary").filter(F.octet_length("items") > 0), "items")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("items")), F.lit(0))).first()
    passes = max(-(-n // items_per_pass), -(-size // PASS_BYTES))

    @C.tidy
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(np.frombuffer(x, np.uint64)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*held, np.zeros(0, np.uint64)]).view(np.int64))], ["value"])

    shared = rows.select("items").mapInArrow(distinct, "value long").groupBy("value").agg(F.count("*").alias("df")).filter("df > 1").toArrow()
    keys, df = shared.column("value").to_numpy().view(np.uint64), shared.column("df").to_numpy()
    order = np.argsort(keys)
    keys, df = keys[order], df[order]
    for p in range(passes):
        own = rows if passes == 1 else rows.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == p)
        got = sorted((r.id, bytes(r.items)) for r in own.collect())
        hashes = [np.frombuffer(b, np.uint64) for _, b in got]
        yield Benchmark([i for i, _ in got], hashes, n, keys, df)


def _found(bench: Benchmark, raw: np.ndarray, offsets: np.ndarray, shingle: int, least: float) -> Iterator[tuple[int, tuple]]:
    for i, j in C.blocks(offsets, C.BLOCK // 4):
        words, before = C.words_of(*folded(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        whole = C.shingle_hashes(words, shingle)
        upto = np.concatenate([[0], np.cumsum(bench.hits(whole))])
        n = np.diff(before)
        last = np.minimum(np.maximum(before[1:] - shingle + 1, before[:-1]), len(whole))
        some = (n < shingle) | (upto[last] > upto[np.minimum(before[:-1], len(whole))])
        for k in np.flatnonzero(some & (n > 0)).tolist():
            h = C.doc_shingles(words[before[k] : before[k + 1]], np.array([0, n[k]]), shingle)[0]
            hit = bench.hits(h)
            if hit.any():
                for m in bench.matches(h, hit, least):
                    yield i + k, m


def matches(docs: DataFrame, items: DataFrame, *, shingle: int = 5, least: float = 0.8, items_per_pass: int = 2000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, hamming, first_shingle, n_shingles: the best window of each item in each document.

    Null and empty texts match nothing; a text of fewer words than a shingle is one shingle.  Repeated rows give repeated matches, null
    document ids stay null.  Without items or documents there are no rows.  Columns not named are not read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, hamming long, first_shingle long, n_shingles long"
    out = spark.createDataFrame([], schema)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for bench in benchmark_passes(items, shingle, items_per_pass, item_id, item_text):
        shared = spark.sparkContext.broadcast(bench)

        @C.tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                raw, offs = C.text_buffer(batch.column(1))
                got = list(_found(b, raw, offs, shingle, least))
                at = pa.array([k for k, _ in got], pa.int64())
                kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                cols = list(zip(*((b.ids[m[0]], *m[1:]) for _, m in got), strict=True)) if got else [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "item_id", "similarity", "hamming", "first_shingle", "n_shingles"])

        out = out.union(slim.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, *, shingle: int = 5, least: float = 0.8, items_per_pass: int = 2000, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item."""
    flat, (at,) = C.flattened(docs, text_col)
    for bench in benchmark_passes(items, shingle, items_per_pass, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        @C.tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offs = C.text_buffer(batch.column(at))
                keep = np.ones(batch.num_rows, bool)
                keep[[k for k, _ in _found(shared.value, raw, offs, shingle, least)]] = False
                yield batch.filter(pa.array(keep))

        flat = flat.mapInArrow(run, flat.schema)
    return flat.toDF(*docs.columns)
