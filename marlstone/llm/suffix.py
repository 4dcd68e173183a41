"""Removal of repeated byte strings by difference-cover suffix sorting.

A byte goes if a string of ``length`` bytes (100) that covers it also starts earlier: in a document of smaller id, or earlier in its own.

*Dealing out.*  A 32-byte gram is the anchor of a window of ``length`` bytes if its hash is least among the grams in the window (the leftmost
of equal ones).  Equal windows have equal anchors, so windows are dealt by the hash of their anchor.  The context of an anchor, all bytes
that any of its windows may cover, is told apart by two independent hashes (96 bits, beside 48 of the anchor's): windows of a context that
occurs before are repeats, and equal contexts count once.  An anchor with a single context has no other repeats and needs no sorting.

*Suffix sorting.*  The contexts that share an anchor with others are dealt to buckets of bounded size.  Each bucket sorts all suffixes of
its contexts by the difference-cover algorithm (sampled triples are sorted and named, names are sorted by recursion, the remaining
suffixes are merged in), and compares the prefixes of neighbours.  Of equal windows the first in the corpus stays.  An anchor with
more than ``HOT`` contexts does not go to one bucket: its windows are dealt by their own hash (128 bits) instead, once a file.

Documents are first written, in order of id, to files of bounded size in the shared folder; a place in the corpus is (file, byte), which
orders them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

GRAM, HOT = 32, 2048
BUCKET = 1 << 19  # bytes of contexts that a bucket is meant to hold
FILE = 1 << 26  # bytes of texts in a file; a document that is larger has one of its own
_BASE = np.uint64(0xD1342543DE82EF95)


def difference_cover(codes: np.ndarray) -> np.ndarray:
    """The suffix array of positive integers (end of text is less than all), by difference cover modulo 3."""
    n = len(codes)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: codes[i:].tolist()), np.int64)
    t = np.concatenate([codes.astype(np.int64), np.zeros(3, np.int64)])
    n12 = np.arange(n + (n % 3 == 1))
    n12 = n12[n12 % 3 != 0]  # with a dummy at n if n % 3 == 1, so that each class ends in a triple of its own
    t = np.concatenate([t, np.zeros(2, np.int64)])
    wide = int(t.max()).bit_length()
    if 3 * wide <= 63:
        key = (t[n12] << 2 * wide) | (t[n12 + 1] << wide) | t[n12 + 2]
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    else:
        order = np.lexsort((t[n12 + 2], t[n12 + 1], t[n12]))
        a = n12[order]
        fresh = np.concatenate([[True], (t[a[1:]] != t[a[:-1]]) | (t[a[1:] + 1] != t[a[:-1] + 1]) | (t[a[1:] + 2] != t[a[:-1] + 2])])
    key = sorted_key = a = None  # memory is given back early, above all before the recursion
    if fresh.all():
        sa12 = n12[order]
    else:  # recurse on the names, class 1 before class 2
        rank = np.zeros(n + 5, np.int64)
        rank[n12[order]] = np.cumsum(fresh)
        place = np.concatenate([n12[n12 % 3 == 1], n12[n12 % 3 == 2]])
        names = rank[place]
        n12 = order = fresh = rank = None
        sa12 = place[difference_cover(names)]
        names = place = None
    n12 = order = fresh = None
    rank = np.zeros(n + 5, np.int64)
    rank[sa12] = np.arange(1, len(sa12) + 1)
    sa12 = sa12[sa12 < n]
    # the remaining suffixes, by first symbol and the rank of what follows
    zero = np.arange(0, n, 3)
    bits = int(len(rank)).bit_length()
    key0 = (t[zero] << bits) | rank[zero + 1]
    order = np.argsort(key0)
    zero, key0 = zero[order], key0[order]
    one, two = sa12[sa12 % 3 == 1], sa12[sa12 % 3 == 2]
    below = np.searchsorted((t[one] << bits) | rank[one + 1], key0)
    one = order = key0 = None
    pair0, pair2 = (t[zero] << 32 | t[zero + 1]), (t[two] << 32 | t[two + 1])
    if int(t.max()) < 2**16 and bits <= 31:
        k0, k2 = (t[zero] << 16 | t[zero + 1]) << bits | rank[zero + 2], (t[two] << 16 | t[two + 1]) << bits | rank[two + 2]
    else:  # pairs of symbols are named first
        pairs = np.unique(np.concatenate([pair0, pair2]))
        k0, k2 = np.searchsorted(pairs, pair0) << bits | rank[zero + 2], np.searchsorted(pairs, pair2) << bits | rank[two + 2]
    below = below + np.searchsorted(k2, k0)
    k0 = k2 = pair0 = pair2 = pairs = two = t = rank = None
    out = np.empty(n, np.int64)
    at = below + np.arange(len(zero))
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sa12
    return out


def gram_hashes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes of all grams; those that run over the end of their document are the greatest value."""
    h = C.BYTE_VALUES[raw]
    size = 1
    while size < GRAM:
        h = h[: max(0, len(h) - size)] * np.uint64(pow(int(_BASE), size, 2**64)) + h[size:]
        size *= 2
    out = np.full(len(raw), np.uint64(2**64 - 1))
    out[: len(h)] = C.mix(h) & np.uint64(2**64 - 2)
    ends = offsets[1:]
    for back in range(1, GRAM):
        at = ends - back
        out[at[(at >= offsets[:-1])]] = np.uint64(2**64 - 1)
    return out


def _anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    w, n = length - GRAM + 1, len(raw)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(raw, offsets)
    # the least hash, leftmost of equals, of each window: minima over powers of two of (hash, place)
    best, place, size = h.copy(), np.arange(n, dtype=np.int32), 1
    while size * 2 <= w:
        left, right = best[:-size], best[size:]
        take = right < left
        best, place = np.where(take, right, left), np.where(take, place[size:], place[:-size])
        size *= 2
    m = n - length + 1
    left, right, far = best[:m], best[w - size : w - size + m], place[w - size : w - size + m]
    place = np.where(right < left, far, place[:m])
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[:m]
    sound = np.flatnonzero(np.arange(m) + length <= offsets[1:][doc])
    place = place[sound]
    edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (sound[1:] != sound[:-1] + 1)])) if len(sound) else np.zeros(0, np.int64)
    last = np.append(edge[1:], len(sound)) - 1
    x = place[edge].astype(np.int64)
    return x, h[x], sound[edge], sound[last]


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, block: int = C.BLOCK // 4) -> tuple[np.ndarray, ...]:
    """Anchors of documents: (place, hash, first window, last window, two hashes of the context), in order of first window.

    Documents are taken in blocks, and long ones in stretches that begin with the first window of an anchor.
    """
    w, found = length - GRAM + 1, []

    def add(at: int, part: tuple[np.ndarray, ...], doc_start: np.ndarray | int, doc_end: np.ndarray | int) -> None:
        x, h, lo, hi = part
        x, lo, hi = x + at, lo + at, hi + at
        start, end = np.maximum(doc_start, x - (w - 1)), np.minimum(doc_end, x + length)
        if len(x):
            a, b = int(start.min()), int(end.max())
            where = C.mix((x - start).astype(np.uint64))
            found.append((x, h, lo, hi, C.span_hashes(raw[a:b], start - a, end - a) ^ where, (_second(raw[a:b], start - a, end - a) + where).astype(np.uint32)))

    for i, j in C.blocks(offsets, block):
        at, end = int(offsets[i]), int(offsets[j])
        if j > i + 1 or end - at <= 2 * block:
            offs = offsets[i : j + 1] - at
            part = _anchors(raw[at:end], offs, length)
            d = np.searchsorted(offsets, part[2] + at, "right") - 1
            add(at, part, offsets[d], offsets[d + 1])
            continue
        while True:
            stop = min(end, at + block)
            part = _anchors(raw[at:stop], np.array([0, stop - at]), length)
            if stop == end:
                add(at, part, int(offsets[i]), end)
                break
            add(at, tuple(v[:-1] for v in part), int(offsets[i]), end)
            at += int(part[2][-1])
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64), none.astype(np.uint32)
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _groups(path: str, columns: list[str] | None = None) -> Iterator[pa.Table]:
    """The row groups of a file (these columns of them), one after another."""
    fs, at = C.filesystem(path)
    with fs.open_input_file(at) as f:
        file = pq.ParquetFile(f, pre_buffer=False)
        for i in range(file.num_row_groups):
            yield file.read_row_group(i, columns=columns, use_threads=False)


def _texts(path: str, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of a file, of size bytes; but for these only one row group is held at a time."""
    raw, offsets, at = np.empty(size, np.uint8), [np.zeros(1, np.int64)], 0
    for t in _groups(path, [text]):
        data, offs = C.text_buffer(t.column(text))
        raw[at : at + len(data)] = data
        offsets.append(offs[1:] + at)
        at += len(data)
    return raw, np.concatenate(offsets)


def _differs(v: np.ndarray) -> np.ndarray:
    """Whether each value is another than the one before it."""
    return np.concatenate([np.ones(min(1, len(v)), bool), v[1:] != v[:-1]])


def _side(path: str) -> str:
    return path + ".anchors"


def _runs(windows: np.ndarray) -> np.ndarray:
    """Ascending windows as pairs (first, number)."""
    if not len(windows):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(windows) != 1) + 1
    first = np.concatenate([[0], cut])
    return np.stack([windows[first], np.diff(np.append(first, len(windows)))], 1)


def _covered(windows: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes under windows, given as (first, number) pairs."""
    both = np.concatenate([*windows, np.zeros((2, 0), np.int64)], 1)
    both = both[:, np.argsort(both[0], kind="stable")]
    ends = np.maximum.accumulate(both[0] + both[1] + length - 1) if both.shape[1] else both[0]
    fresh = np.concatenate([[True], both[0][1:] > ends[:-1]]) if len(ends) else np.zeros(0, bool)
    return both[0][fresh], ends[np.concatenate([fresh[1:], [True]])] if len(ends) else ends


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def bucket_repeats(texts: list[np.ndarray], place: np.ndarray, length: int) -> np.ndarray:
    """Places of windows that occur before, in a bucket; a text holds the windows that start at place[k], place[k] + 1, ..."""
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.zeros(at[-1], np.int64)
    joined = np.concatenate(texts).astype(np.int64) + 2
    codes[:] = 1  # what stands between two texts
    codes[_spread(at[:-1], sizes)] = joined
    del joined
    order = difference_cover(codes)
    n = sizes - length + 1
    starts = _spread(at[:-1], n)
    corpus = np.full(len(codes), -1, np.int64)
    corpus[starts] = _spread(place, n)
    order = order[corpus[order] >= 0]
    view = np.lib.stride_tricks.sliding_window_view((codes - 2).astype(np.uint8), length)
    same = np.zeros(len(order), bool)
    for i in range(1, len(order), 1 << 15):
        j = min(len(order), i + (1 << 15))
        same[i:j] = (view[order[i:j]] == view[order[i - 1 : j - 1]]).all(1)
    where = corpus[order]
    group = np.cumsum(~same) - 1
    least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, where)
    return np.sort(where[where != least[group]])


def remove_repeats(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.  texts: all columns of docs instead, the text without repeats.

    Null texts are empty.  Null ids come after all others; rows of equal id follow each other in order of text, and count as different
    documents.  Removal may cut a character: kept bytes that are no whole character are left out of a returned text; a null text stays
    null.  An empty table gives no rows.
    """
    spark, parts = C.gentle(docs.sparkSession), C.parts(docs.sparkSession)
    root = C.scratch(spark, "suffix")
    slim = docs if texts else docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    names = [f"c{i}" for i in range(len(slim.columns))]  # names may clash but for case
    flat = slim.toDF(*names)
    id_at, text_at = slim.columns.index(id_col), slim.columns.index(text_col)
    text_name = names[text_at]

    @C.tidy
    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, w, size, done = TaskContext.get().partitionId(), None, 0, []

        def close() -> None:
            nonlocal w, size
            if w is not None:
                w.close()
                done.append((number, len(done), path, size))
            w, size = None, 0

        for b in batches:
            at = 0
            while at < b.num_rows:
                ends = np.cumsum(C.sizes_of(b.column(text_at))[at:])
                n = max(1 if size == 0 else 0, int(np.searchsorted(ends, FILE - size, "right")))  # rows that the file still holds
                if not n:
                    close()
                    continue
                if w is None:
                    path = f"{root}/part-{number:06d}-{len(done):06d}.parquet"
                    fs, place = C.filesystem(path)
                    fs.create_dir(place.rpartition("/")[0], recursive=True)
                    w = pq.ParquetWriter(fs.open_output_stream(place), b.schema, compression="zstd", use_dictionary=False)
                for k in range(at, at + n, 2000):
                    w.write_batch(b.slice(k, min(2000, at + n - k)))
                size += int(ends[n - 1])
                at += n
        close()
        yield pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in done], kind) for i, (name, kind) in enumerate([("task", pa.int64()), ("nth", pa.int64()), ("path", pa.string()), ("size", pa.int64())])})

    ordered = flat.repartitionByRange(parts, F.col(names[id_at]).asc_nulls_last()).sortWithinPartitions(F.col(names[id_at]).asc_nulls_last(), text_name)
    # one small row a file; files are numbered in the order of the corpus
    got = sorted(tuple(r) for r in ordered.mapInArrow(copy, "task long, nth long, path string, size long").collect())
    files = [(n, path, size) for n, (_, _, path, size) in enumerate(got)]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if not files:
        return slim if texts else spark.createDataFrame([], schema)
    segments = max(parts, sum(f[2] for f in files) // (35 * 500_000))  # a segment and a file share a row, if they share an anchor
    listed = spark.createDataFrame(files, "part long, path string, size long").repartition(len(files), "part")

    @C.tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, h, lo, hi, ctx, ctx2 = anchors(*_texts(path, text_name, size), length)
                seg = (h >> np.uint64(40)) % np.uint64(segments)
                order = np.lexsort((np.arange(len(h)), ctx2, ctx, h))
                first = _differs(h[order]) | _differs(ctx[order]) | _differs(ctx2[order])
                leads = np.zeros(len(h), bool)
                leads[order] = first  # the others repeat a context of this file
                fs, at = C.filesystem(_side(path))
                with fs.open_output_stream(at, compression=None) as f:
                    f.write(np.array([len(x)], "<i8").tobytes() + lo.astype("<u4").tobytes() + (hi - lo + 1).astype("<u2").tobytes() + (x - lo).astype("<u2").tobytes() + seg.astype("<u4").tobytes() + np.packbits(leads).tobytes())
                order = np.argsort(seg[leads], kind="stable")
                cut = np.searchsorted(seg[leads][order], np.arange(segments + 1, dtype=np.uint64))
                low = h[leads][order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].copy()
                c, c2 = ctx[leads][order], ctx2[leads][order]
                own = [s for s in range(segments) if cut[s + 1] > cut[s]]
                step = max(1, min(256, 100_000 * len(own) // max(1, len(c))))  # rows of a batch: some 100,000 anchors
                for k in range(0, len(own), step):
                    some = own[k : k + step]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([part] * len(some), pa.int64()), C.packed([low[cut[s] : cut[s + 1]].ravel() for s in some]), C.packed([c[cut[s] : cut[s + 1]] for s in some]), C.packed([c2[cut[s] : cut[s + 1]] for s in some])], ["seg", "part", "grams", "contexts", "more"])

    @C.tidy
    def judge(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((p, g, c, c2) for b in group for _, p, g, c, c2 in zip(*(x.to_pylist() for x in b.columns), strict=True)), key=lambda r: r[0])
        n = [len(r[2]) // 8 for r in rows]
        wide = np.zeros((sum(n), 8), np.uint8)
        wide[:, :6] = np.concatenate([np.frombuffer(r[1], np.uint8) for r in rows]).reshape(-1, 6)
        h, ctx, ctx2 = wide.view("<u8").ravel(), np.concatenate([np.frombuffer(r[2], "<u8") for r in rows]), np.concatenate([np.frombuffer(r[3], "<u4") for r in rows])
        order = np.lexsort((np.arange(len(h)), ctx2, ctx, h))
        h, ctx, ctx2 = h[order], ctx[order], ctx2[order]
        new = _differs(h)
        first = new | _differs(ctx) | _differs(ctx2)
        group_of = np.cumsum(new) - 1
        kinds = np.bincount(group_of[first])[group_of]
        flags = np.empty(len(h), np.uint8)  # 0: nothing more to do, 1: windows occur before, 2: to be sorted, 3: to be hashed
        flags[order] = np.where(~first, 1, np.where(kinds < 2, 0, np.where(kinds > HOT, 3, 2)))
        ends = np.cumsum(n)
        seg = key[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, *_ in rows], pa.int64()), pa.array([seg] * len(rows), pa.int64()), C.packed([flags[e - k : e] for e, k in zip(ends.tolist(), n, strict=True)]), pa.array([int((flags[e - k : e] == 2).sum()) for e, k in zip(ends.tolist(), n, strict=True)], pa.int64())], ["part", "seg", "flags", "n"])

    dealt = listed.mapInArrow(find, "seg long, part long, grams binary, contexts binary, more binary")
    flags, _ = C.store(dealt.groupBy("seg").applyInArrow(judge, "part long, seg long, flags binary, n long"), "flags")
    paths = {p: (path, size) for p, path, size in files}  # a path a file, as in the plan of any scan
    sorting = flags.agg(F.sum("n")).first()[0] or 0
    buckets = max(parts, sorting * (length + 30) // BUCKET)

    def load(path: str, rows: dict[int, bytes]) -> tuple:
        """(lo, windows, place of the anchor, flags) of the anchors of a file, and which lead their context in it."""
        fs, at = C.filesystem(_side(path))
        with fs.open_input_stream(at, compression=None) as f:
            data = f.read()
        n = int(np.frombuffer(data, "<i8", 1)[0])
        lo, k = np.frombuffer(data, "<u4", n, 8).astype(np.int64), np.frombuffer(data, "<u2", n, 8 + 4 * n).astype(np.int64)
        x, seg = lo + np.frombuffer(data, "<u2", n, 8 + 6 * n), np.frombuffer(data, "<u4", n, 8 + 8 * n)
        leads = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 12 * n), count=n).astype(bool) if n else np.zeros(0, bool)
        out = np.ones(n, np.uint8)
        at_lead = np.flatnonzero(leads)
        order = at_lead[np.argsort(seg[at_lead], kind="stable")]
        if len(order):
            out[order] = np.frombuffer(b"".join(rows[s] for s in sorted(rows)), np.uint8)
        return lo, k, x, out

    @C.tidy
    def contexts(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        rows = {s: f for b in group for s, f in zip(b.column("seg").to_pylist(), b.column("flags").to_pylist(), strict=True)}
        lo, k, x, flag = load(paths[part][0], rows)
        todo = np.flatnonzero(flag >= 2)
        if not len(todo):
            return
        raw, _ = _texts(paths[part][0], text_name, paths[part][1])
        schema = ["bucket", "part", "places", "sizes", "data"]
        for some in np.array_split(todo, -(-len(todo) // 20000)):
            own = some[flag[some] == 2]
            bucket = (_gram_keys(raw, x[own]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            own, bucket = own[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
            out = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                c = own[a:b]
                size = k[c] + length - 1
                out.append((int(bucket[a]), part, lo[c].astype("<u4"), k[c].astype("<u2"), raw[_spread(lo[c], size)]))
            hot = some[flag[some] == 3]
            if len(hot):
                windows = _spread(lo[hot], k[hot])
                h1, h2 = _window_hashes(raw, windows, length)
                slot = (h1 % np.uint64(parts)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                cut = np.searchsorted(slot[order], np.arange(parts + 1))
                for s in range(parts):
                    c = order[cut[s] : cut[s + 1]]
                    if len(c):
                        out.append((-1 - s, part, windows[c].astype("<u4"), np.zeros(0, "<u2"), np.stack([h1[c], h2[c]]).astype("<u8").ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), *(C.packed([r[i] for r in out]) for i in (2, 3, 4))], schema)

    @C.tidy
    def repeats(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in group for r in zip(*(x.to_pylist() for x in b.columns), strict=True)]
        where = np.concatenate([np.frombuffer(p, "<u4").astype(np.int64) | part << 32 for _, part, p, *_ in rows])
        if key[0].as_py() < 0:
            pairs = [np.frombuffer(d, "<u8").reshape(2, -1) for *_, d in rows]
            h = np.concatenate(pairs, 1)
            order = np.lexsort((where, h[1], h[0]))
            h, where = h[:, order], where[order]
            again = np.flatnonzero(np.concatenate([[False], (h[0, 1:] == h[0, :-1]) & (h[1, 1:] == h[1, :-1])]))
            found = np.sort(where[again])
        else:
            n = np.concatenate([np.frombuffer(s, "<u2") for *_, s, _ in rows]).astype(np.int64)
            text = np.concatenate([np.frombuffer(d, np.uint8) for *_, d in rows])
            ends = np.cumsum(n + length - 1)
            found = bucket_repeats(np.split(text, ends[:-1]), where, length)
        runs = _runs(found)
        part = runs[:, 0] >> 32
        own = np.unique(part)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([-1] * len(own), pa.int64()), C.packed([np.stack([runs[part == p, 0] & 0xFFFFFFFF, runs[part == p, 1]]).astype("<i8").ravel() for p in own])], ["part", "seg", "flags"])

    sent = flags.select("part", "seg", "flags").groupBy("part").applyInArrow(contexts, "bucket long, part long, places binary, sizes binary, data binary")
    found, _ = C.store(sent.groupBy("bucket").applyInArrow(repeats, "part long, seg long, flags binary"), "repeats")
    columns, fields = list(slim.columns), slim.schema

    @C.tidy
    def finish(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        rows, windows = {}, []
        for b in group:
            for s, f in zip(b.column("seg").to_pylist(), b.column("flags").to_pylist(), strict=True):
                if s == -1:
                    windows.append(np.frombuffer(f, "<i8").reshape(2, -1))
                elif s >= 0:
                    rows[s] = f
        if rows:
            lo, k, _, flag = load(paths[part][0], rows)
            windows.append(np.stack([lo[flag == 1], k[flag == 1]]))
            del lo, k, flag
        first, last = _covered(windows, length)
        rows.clear()
        windows.clear()
        base = 0  # bytes of the row groups before
        for table in _groups(paths[part][0]):
            raw, offs = C.text_buffer(table.column(text_name))
            yield from without(table, raw, offs, first - base, last - base)
            base += len(raw)

    def without(table: pa.Table, raw: np.ndarray, offs: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What finish returns of a row group; the runs of its file that go are [first, last), counted from its first byte."""
        a, b = np.searchsorted(last, offs[:-1], "right"), np.searchsorted(first, offs[1:], "left")  # runs that a document meets
        kept, removed, data = [], np.zeros(len(offs) - 1, np.int64), memoryview(raw)
        for i, (at, end) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            if b[i] <= a[i] or at == end:
                kept.append(bytes(data[at:end]))
                continue
            own, place = [], at
            for x, y in zip(first[a[i] : b[i]].tolist(), last[a[i] : b[i]].tolist(), strict=True):
                x, y = max(x, at), min(y, end)  # runs of two documents may touch
                own.append(data[place:x])
                removed[i] += y - x
                place = y
            kept.append(b"".join([*own, data[place:end]]))
        spans = np.where(np.diff(offs) > 0, np.maximum(b - a, 0), 0)
        if texts:
            null = table.column(text_name).is_null().to_pylist()
            new = pa.array([None if z else t.decode("utf-8", "ignore") for t, z in zip(kept, null, strict=True)], table.schema.field(text_at).type)
            table = table.set_column(text_at, names[text_at], new)
            emptied = np.array([not t for t in kept], bool) & (np.diff(offs) > 0)
            yield from table.filter(pa.array(~emptied)).combine_chunks().to_batches(max_chunksize=1000)
            return
        yield pa.RecordBatch.from_arrays(
            [table.column(id_at).combine_chunks(), pa.array(np.diff(offs)), pa.array(removed), pa.array(spans.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    all_parts = listed.select("part", F.lit(-2).cast("long").alias("seg"), F.lit(b"").alias("flags"))  # files without any anchor too
    replies = flags.select("part", "seg", "flags").union(found).union(all_parts).groupBy("part")
    if texts:
        return replies.applyInArrow(finish, flat.schema).toDF(*columns)
    return replies.applyInArrow(finish, schema)


def _gram_keys(raw: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Keys of the grams of a file, at ascending places, stretch by stretch."""
    out = np.empty(len(x), np.uint64)
    at = 0
    while at < len(x):
        j = int(np.searchsorted(x, x[at] + C.BLOCK // 4, "right"))
        a = int(x[at])
        out[at:j] = C.mix(C.span_hashes(raw[a : int(x[j - 1]) + GRAM], x[at:j] - a, x[at:j] - a + GRAM))
        at = j
    return out


_OTHER = np.uint64(0xA24BAED4963EE407)  # the base of the second of two independent hashes
_SHIFTED = C.mix(C.BYTE_VALUES + np.uint64(0x9E6C63D0876A9A35)) | np.uint64(1)


def _second(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans by other byte values and another base."""
    out = np.zeros(len(starts), np.uint64)
    if not len(raw):
        return out
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(raw), _OTHER)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_SHIFTED[raw] * up[:-1])])
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(raw), np.uint64(pow(int(_OTHER), -1, 2**64)))]))
    return C.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _window_hashes(raw: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of windows, in two independent halves."""
    h1, h2 = np.empty(len(windows), np.uint64), np.empty(len(windows), np.uint64)
    for i in range(0, len(windows), 4096):
        own = windows[i : i + 4096]
        flat, at = raw[own[:, None] + np.arange(length)].ravel(), np.arange(len(own)) * length
        h1[i : i + 4096] = C.span_hashes(flat, at, at + length)
        h2[i : i + 4096] = _second(flat, at, at + length)
    return h1, h2
