"""Shared helpers: scratch folders, vectorised word hashing, packed columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, after lower-casing A-Z, everywhere in this
subpackage.  Hashes are 64 bit: a polynomial over random byte values modulo 2**64, then a finaliser.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes handled at once by the vectorised code; a longer word makes its block longer.
BLOCK = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); where none is set (tests), an own one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = getattr(sc, "_marlstone_scratch", None)
    if known is None:
        known = sc._marlstone_scratch = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, known, ignore_errors=True)
    return "file://" + known


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/marlstone/{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str, tidy_shuffles: bool = False) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: lineage is cut, any executor can read the files.

    With tidy_shuffles, Spark deletes the shuffle files of the write as it ends: nothing reads them again, and release() often finds their plan
    still held somewhere in the JVM.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    if tidy_shuffles:
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch folders that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs: it does so when their plans are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Has executors collect their garbage, so that a heap that the steps before have filled goes back to the system.

    A task a core: an idle cluster deals them to all executors; one that gets none keeps its memory, nothing else depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def trim() -> None:
    """Gives freed memory back to the system: large arrays otherwise stay with a long-lived worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(fn):
    """fn, a generator over batches (or the batches of a group), that leaves nothing behind in its worker: workers outlive tasks and stages."""

    def told(outs):
        for out in outs:
            yield out
            del out
            trim()
        trim()

    if fn.__code__.co_argcount - len(fn.__defaults__ or ()) == 2:  # Spark counts the arguments of functions of groups

        @functools.wraps(fn)
        def run(key, group):
            yield from told(fn(key, group))

    else:

        @functools.wraps(fn)
        def run(batches):
            yield from told(fn(batches))

    return run


def gentle(spark: SparkSession, size: str = "8m") -> SparkSession:
    """Arrow batches of 8 MB, or of size, instead of Spark's default of 64 MB (another value that was set stays): long texts make large batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", "67108864", "67108864b") or size != "8m" and spark.conf.get(name) == "8m":
        spark.conf.set(name, size)
    return spark


def _may_hold(need: DataFrame, key: str, most_bits: int):
    """A condition on a long column: true for all keys of need, and for few others.

    A Bloom filter of at most 2**most_bits bits (8 MB), made by an aggregation; it goes to tasks as the value of a subquery of one row and
    is read in the JVM.  With many more keys than bits it is true for more, at worst for all.
    """
    spark = need.sparkSession
    bits = max(10, min(most_bits, (16 * need.count()).bit_length()))
    places = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(1 << bits)) for i in range(4)]
    at = need.select(F.explode(F.array(*places)).alias("at"))
    got = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), "<i8")
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    data = spark.createDataFrame([(words.tobytes(),)], "data binary").scalar()
    holds = F.lit(True)
    for p in places:
        byte = F.conv(F.hex(F.substring(data, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        holds = holds & (F.getbit(byte, (p % 8).cast("int")) == 1)
    return holds


def likely(df: DataFrame, need: DataFrame, key: str, most_bits: int = 26) -> DataFrame:
    """The rows of df whose key may be one of need's: all that are, and few others, so that a join after it shuffles little of df.

    The join decides: where the filter lets more rows pass, only its shuffle grows.
    """
    return df.filter(F.col(key).isNotNull()).filter(_may_hold(need, key, most_bits))


def without(df: DataFrame, gone: DataFrame, key: str, most_bits: int = 26) -> DataFrame:
    """The rows of df whose key is not one of gone's (null keys stay); only rows that may be are shuffled, by a join that decides."""
    may = F.col(key).isNotNull() & _may_hold(gone, key, most_bits)
    return df.filter(~may).union(df.filter(may).join(gone, key, "left_anti").select(*df.columns))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a scratch folder, usable by the driver and by tasks."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flattened(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[int]]:
    """df with columns c0, c1, ... (its names may be equal but for case), and the places of the wanted ones.

    A name stands for the column of just that name, else for the only one that is equal but for case.
    """
    places = []
    for name in wanted:
        at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if len(at) != 1:
            raise ValueError(f"{'no' if not at else 'more than one'} column {name}")
        places += at
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), places


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "" if "string" in str(col.type) else b"")
    kind = np.int64 if "large" in str(col.type) else np.int32
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def sizes_of(col: pa.Array) -> np.ndarray:
    """Bytes of each string; null counts as empty."""
    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i modulo 2**64 for i < n; kept for the usual block, made anew beyond it."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(1 << (n - 1).bit_length(), BLOCK // 4) if n <= 2 * BLOCK else n
    made = []
    for b in (BASE, INVERSE):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size <= 2 * BLOCK:
        _powers[:] = made
    return made[0], made[1]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends) of raw."""
    up, down = powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans_hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = BLOCK // 8) -> np.ndarray:
    """The same hashes for ascending spans that do not overlap, stretch by stretch: in memory that long texts do not raise."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + size, "right")))
        out[i:j] = span_hashes(raw[a : int(ends[j - 1])], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words before each document (one more than documents)."""
    space = SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1] | cut[1 : len(raw)]
    last = word.copy()
    last[:-1] &= space[1:] | cut[1 : len(raw)]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def blocks(offsets: np.ndarray, size: int = BLOCK):
    """Ranges of whole documents of about size bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of documents, and the number of words before each document.

    A very long document is taken block by block, cut at white space, so that memory stays bounded by its bytes.
    """
    if len(raw) <= 2 * BLOCK:
        raw = LOWER[raw] if lower else raw
        starts, ends, before = word_spans(raw, offsets)
        return span_hashes(raw, starts, ends), before
    out, counts = [], []
    for i, j in blocks(offsets):
        at, end, total, mine = offsets[i], offsets[j], 0, []
        if j > i + 1 or end - at <= 2 * BLOCK:
            h, before = words_of(raw[at:end], offsets[i : j + 1] - at, lower)
            out.append(h)
            counts.append(np.diff(before))
            continue
        while at < end:
            stop = min(end, at + BLOCK)
            while stop < end and not SPACE[raw[stop]]:
                gap = np.flatnonzero(SPACE[raw[stop : stop + BLOCK]])
                stop = stop + int(gap[0]) if len(gap) else min(end, stop + BLOCK)
            part = LOWER[raw[at:stop]] if lower else raw[at:stop]
            s, e, _ = word_spans(part, np.array([0, len(part)]))
            mine.append(span_hashes(part, s, e))
            total, at = total + len(s), stop
        out += mine
        counts.append(np.array([total]))
    before = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), before.astype(np.int64)


_FACTORS = [int(x) | 1 for x in _rng.integers(1, 2**63, 16, dtype=np.uint64)]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k successive words at each of len(words) - k + 1 places."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += words[i : i + n] * np.uint64(_FACTORS[i])
    return mix(h)


def doc_shingles(words: np.ndarray, before: np.ndarray, k: int) -> list[np.ndarray]:
    """The shingles of each document in text order; fewer than k words give one shingle, none gives none."""
    whole = shingle_hashes(words, k)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(whole[a : b - k + 1])
        elif b > a:
            out.append(shingle_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(whole[:0])
    return out


def packed(chunks: list[np.ndarray]) -> pa.Array:
    """A binary column with one array a row."""
    sizes = np.fromiter((c.nbytes for c in chunks), np.int64, len(chunks))
    offsets = np.zeros(len(chunks) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    data = np.concatenate([np.ascontiguousarray(c).view(np.uint8) for c in chunks]) if len(chunks) else np.zeros(0, np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def long_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, is null) of an integer column."""
    return pc.fill_null(col, 0).to_numpy(zero_copy_only=False).astype(np.int64), col.is_null().to_numpy(zero_copy_only=False)
