"""Winnowing fingerprints of documents.

Rolling hashes of k-grams of code points; in each window of w successive k-grams the least hash is chosen, the rightmost of equal
ones, and kept once with its position.  Any match of at least w + k - 1 code points shares a fingerprint; matches shorter than k never do
(but for chance).  A text with fewer than w k-grams is one window; one shorter than k has the hash of the whole text at position 0;
an empty text has none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

K, W = 20, 41  # a match of 60 code points is found
_PIECE = 1 << 20
_BASE = np.uint64(0xD1342543DE82EF95)


def _pow(e: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), e, 2**64))


def _rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams: doubled polynomial hashes, put together for any k."""
    h = C.mix(codes.astype(np.uint64) + np.uint64(1))
    n, size, out, done = len(codes) - k + 1, 1, None, 0
    while True:
        if k & size:
            part = h[done : done + n]
            out = part.copy() if out is None else out * _pow(size) + part
            done += size
        if done == k:
            break
        h = h[: len(h) - size] * _pow(size) + h[size:]
        size *= 2
    return (C.mix(out) >> np.uint64(32)).astype(np.uint64)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n, size = len(v) - w + 1, 1
    while size * 2 <= w:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    return np.minimum(v[:n], v[w - size : w - size + n])


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint32, positions int64, ascending) of a text; long texts are taken in overlapping pieces."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if n < k:
        return _rolling(codes, n).astype(np.uint32), np.zeros(1, np.int64)
    found = []
    for at in range(0, max(1, n - k - w + 2), _PIECE):
        h = _rolling(codes[at : at + _PIECE + k + w - 2], k)
        key = h << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))  # rightmost of equal hashes is least
        least = _sliding_min(key, min(w, len(h)))
        keep = np.ones(len(least), bool)
        keep[1:] = least[1:] != least[:-1]
        least = least[keep]
        found.append((least >> np.uint64(32), at + 0xFFFFFFFF - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)))
    hashes, places = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = np.ones(len(places), bool)
    keep[1:] = places[1:] != places[:-1]
    return hashes[keep].astype(np.uint32), places[keep]


def to_string(hashes: np.ndarray, places: np.ndarray, w: int = W) -> str:
    """Base64 of all hashes (uint32), then the first position and the gaps between positions, none above w; both little-endian."""
    gaps = np.diff(places, prepend=0)
    return base64.b64encode(hashes.astype("<u4").tobytes() + gaps.astype("<u1" if w < 256 else "<u4").tobytes()).decode()


def from_string(text: str, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a fingerprint string."""
    data = base64.b64decode(text)
    n = len(data) // (5 if w < 256 else 8)
    return np.frombuffer(data, "<u4", n), np.cumsum(np.frombuffer(data, "<u1" if w < 256 else "<u4", n, 4 * n).astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets of distinct hashes, each ascending; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(both) - same)


def edited(text: str, after: str) -> str:
    """The last half of the text (rounded down) replaced by as many code points from the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, ahead, id, text): documents in descending order of id in parts, each part also with the first row of the next.

    Each text is shuffled once.  Only part bounds (quantiles of ids) and the first id of each part come to the driver: two numbers a
    part.  The row after the last is the first of all.
    """
    spark = C.gentle(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 8 * C.parts(spark)
    bounds = slim.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))

    def part_of(ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, id, is null); part 0 holds the largest ids, null ids come after all others."""
        own, null = C.long_column(ids)
        return np.where(null, len(bounds) + 1, len(bounds) - np.searchsorted(bounds, own, "left")).astype(np.int32), own, null

    @F.arrow_udf("int")
    def number(ids: pa.Array) -> pa.Array:
        return pa.array(part_of(ids)[0])

    tops = slim.select("id", number("id").alias("part")).groupBy("part").agg(F.max("id").alias("top")).collect()
    order = sorted((r.part, r.top) for r in tops)
    # the part that ends just before the first id of another; the first id of all follows the last part
    ends = sorted((top, order[i - 1][0]) for i, (_, top) in enumerate(order) if top is not None)
    top_ids, ended = np.array([t for t, _ in ends], np.int64), np.array([p for _, p in ends], np.int32)
    before_nulls = next((order[i - 1][0] for i, (_, top) in enumerate(order) if top is None), None)

    @F.arrow_udf("array<int>")
    def targets(ids: pa.Array) -> pa.Array:
        part, own, null = part_of(ids)
        ahead = np.full(len(own), -1, np.int32)
        if len(top_ids):
            at = np.minimum(np.searchsorted(top_ids, own), len(top_ids) - 1)
            ahead = np.where(top_ids[at] == own, ended[at], -1)
        ahead = np.where(null, -1 if before_nulls is None else before_nulls, ahead)
        sizes = 1 + (ahead >= 0)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.repeat(part, sizes)
        flat[(offsets[1:] - 1)[ahead >= 0]] = -1 - ahead[ahead >= 0]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))

    dealt = slim.withColumn("to", F.explode(targets("id")))
    dealt = dealt.select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("part"), (F.col("to") < 0).alias("ahead"), "id", "text")
    return dealt.repartition(C.parts(spark), "part").sortWithinPartitions("part", "ahead", F.col("id").desc_nulls_last(), "text")


def fingerprints(docs: DataFrame, *, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likenesses.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Null text counts as empty; a null id comes
    last, repeated ids follow each other in order of text; a single document is its own next.  No documents give no rows.  Other
    columns are not read.  Likeness of two empty texts is 1, of an empty and another 0.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []  # held: part, id, text, hashes and places, distinct hashes

        def close(after: tuple) -> None:
            _, doc, text, own, mine = held
            text2 = edited(text, after[2])
            theirs = winnow(text2, k, w)
            out.append((doc, len(text), hashlib.sha256(text2.encode("utf-8", "surrogatepass")).hexdigest(), to_string(*own, w), to_string(*theirs, w), likeness(mine, np.unique(theirs[0])), likeness(mine, after[4])))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            size = 0
            for i in range(batch.num_rows):
                part, ahead, doc, text = (batch.column(c)[i].as_py() for c in range(4))
                if ahead and (held is None or held[0] != part):
                    continue  # another row that follows this part has been used
                own = winnow(text, k, w)
                row = (part, doc, text, own, np.unique(own[0]))
                if held is not None:
                    close(row)
                held = None if ahead else row
                size += len(text)
                if size > 1 << 23:
                    yield flush()
                    size = 0
            yield flush()

    return with_next(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
