"""N-gram language model whose counts lie in a log-frequency Bloom filter.

Counts of unigrams and bigrams are quantised to ``1 + floor(log2 c)``; an n-gram with level q is entered as (n-gram, 1) .. (n-gram, q), and its
level is read back by probing for 1, 2, ... until a probe fails.  The filter holds every word and every bigram.  Its part for the ``head``,
the most frequent words, is of bounded size and broadcast to workers; the rest is a table of segments, each as large as its own entries need at
``bits_per_item``; their number grows with the text, and no segment leaves its task.  All counts below are read from the filter.

    P1(w)   = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w|v)  = (c(v, w) + mu P1(w)) / (c(v) + mu)

To score, the distinct bigrams and rare words of a block of documents are dealt to their segments; levels (and exact counts of words, which
the base score alone uses) come back in the order asked for.  No n-gram is dropped and neither the filter nor the vocabulary is collected.

Counting shuffles packed arrays: a task sorts and sums the n-grams of a block of documents, so a very frequent one is one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a document, and for what is before its first token
HASHES = 6
ALPHA, MU = 0.1, 20.0
_LEVEL = np.uint64(0x2545F4914F6CDD1D)
_TOP = 48


def stream(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of documents, each closed by END, and the number of tokens before each document."""
    words, before = C.words_of(raw, offsets)
    return np.insert(words, before[1:], END), before + np.arange(len(before))


def bigrams(tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bigram keys, context of each token); the first token of a document follows END."""
    prev = np.empty_like(tokens)
    prev[1:] = tokens[:-1]
    prev[before[:-1]] = END
    return C.mix(prev * np.uint64(0x9FB21C651E98DF25) + tokens * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), prev


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts, at)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 0)


def representative(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level: 1, 2.5, 5.5, 11.5, ..."""
    return np.where(level > 0, (3 * 2.0 ** (level - 1) - 1) / 2, 0)


def _salt(level: int) -> np.uint64:
    return np.uint64(level * int(_LEVEL) & (2**64 - 1))


def _probes(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """Places in a segment; each mix gives two places of up to 32 bits."""
    h = C.mix(keys + _salt(level))
    for i in range(HASHES):
        if i and i % 2 == 0:
            h = C.mix(h + _LEVEL)
        yield (h >> np.uint64(32 * (i % 2)) & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class LogFrequencyBloom:
    """2**seg_bits segments of 2**bits bits each; the top bits of a key choose its segment."""

    data: np.ndarray
    seg_bits: int
    bits: int

    def level(self, keys: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Quantised counts, at most ``most`` each."""
        out = np.zeros(len(keys), np.int64)
        base = (keys >> np.uint64(64 - self.seg_bits)).astype(np.int64) << self.bits if self.seg_bits else np.zeros(len(keys), np.int64)
        alive, level = np.flatnonzero(most > 0), 1
        while len(alive):
            for place in range(HASHES):
                if place % 2 == 0:
                    h = C.mix(keys[alive] + _salt(level))
                    if place:
                        h = C.mix(h + _LEVEL)
                at = base[alive] + (h >> np.uint64(32 * (place % 2)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
                hit = (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                alive, h = alive[hit], h[hit]
            out[alive] = level
            level += 1
            alive = alive[most[alive] >= level]
        return out


def segment_bits(keys: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
    """The bytes of one segment that holds keys up to their levels."""
    out = np.zeros(1 << bits, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = keys[level >= q]
        for at in _probes(own, q, bits):
            out[at] = True
    return np.packbits(out, bitorder="little")


def bloom_of(keys: np.ndarray, level: np.ndarray, bits_per_item: int) -> LogFrequencyBloom:
    """A filter of one segment, as large as its entries need."""
    bits = max(6, min(32, (int(level.sum()) * bits_per_item).bit_length()))
    return LogFrequencyBloom(segment_bits(keys, level, bits), 0, bits)


def _dealt(keys: np.ndarray, counts: np.ndarray, kind: int, seg_bits: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    cut = np.searchsorted(keys, np.arange(1, 1 << seg_bits, dtype=np.uint64) << np.uint64(64 - seg_bits)) if seg_bits else np.zeros(0, np.int64)
    cut = np.concatenate([[0], cut, [len(keys)]])
    return [(kind, s, keys[a:b], counts[a:b]) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]


def _narrow(keys: np.ndarray) -> np.ndarray:
    """The low bytes of the top 48 bits: a bigram is told apart by 48 bits (its segment's bits among them)."""
    return (keys >> np.uint64(64 - _TOP)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].copy().ravel()


def _widen(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() << np.uint64(64 - _TOP)


@dataclass
class LanguageModel:
    tokens: int  # N
    vocabulary: int  # V
    head_keys: np.ndarray
    head_counts: np.ndarray
    seg_bits: int
    segments: DataFrame  # seg, bits of the filter, keys and exact counts of the words outside the head
    tail_words: int
    head_filter: LogFrequencyBloom

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return (c + ALPHA) / (self.tokens + ALPHA * (self.vocabulary + 1))


def fit(docs: DataFrame, *, head: int = 1_000_000, max_bits: int = 1 << 28, bits_per_item: int = 12, tokens_per_segment: int = 1 << 20, text_col: str = "text") -> LanguageModel:
    """Counts all of docs.  To the driver come: sums, one histogram of levels a segment, at most ``head`` words.

    Segments are made so many that one needs about ``max_bits`` bits or ``tokens_per_segment`` tokens at most.
    """
    spark = C.gentle(docs.sparkSession)
    slim = docs.select(F.col(text_col).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a token brings one bigram and seldom more than two entries
    seg_bits = max(0, min(20, int(size / 6 / max(1, min(tokens_per_segment, max_bits // (2 * bits_per_item)))).bit_length()))

    @C.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = C.text_buffer(batch.column(0))
            C.trim()
            for i, j in C.blocks(offs, C.BLOCK):
                tokens, before = stream(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                pairs, _ = bigrams(tokens, before)
                rows = _dealt(*summed(tokens), 0, seg_bits) + _dealt(*summed(pairs), 1, seg_bits)
                keys = C.packed([k if kind == 0 else _narrow(k) for kind, _, k, _ in rows])
                small = C.packed([np.minimum(c, 255).astype(np.uint8) for *_, c in rows])
                over = C.packed([np.stack([w := np.flatnonzero(c >= 255), c[w]]).astype("<i8").ravel() for *_, c in rows])
                yield pa.RecordBatch.from_arrays([pa.array([(s << 1) | k for k, s, *_ in rows], pa.int64()), keys, small, over], ["slot", "keys", "small", "over"])

    @C.tidy
    def add(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.trim()
        kind, all_keys, all_counts = key[0].as_py() & 1, [], []
        for batch in group:
            for _, k, small, over in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c, o = np.frombuffer(small, np.uint8).astype(np.int64), np.frombuffer(over, "<i8").reshape(2, -1)
                c[o[0]] = o[1]
                all_keys.append(np.frombuffer(k, "<u8") if kind == 0 else _widen(k))
                all_counts.append(c)
        keys, counts = summed(np.concatenate(all_keys), np.concatenate(all_counts))
        levels_n = np.bincount(levels(counts), minlength=64).astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), C.packed([keys]), C.packed([counts.astype("<i8")]), C.packed([levels_n]), pa.array([int(counts.sum())], pa.int64()), pa.array([len(keys)], pa.int64())], ["slot", "keys", "counts", "levels", "total", "n"])

    dealt = slim.mapInArrow(count, "slot long, keys binary, small binary, over binary")
    table, table_path = C.store(dealt.groupBy("slot").applyInArrow(add, "slot long, keys binary, counts binary, levels binary, total long, n long"), "counts", tidy_shuffles=True)
    tokens = vocabulary = 0
    shares = np.zeros(64, np.int64)
    for r in table.filter("slot % 2 = 0").select("levels", "total", "n").toLocalIterator():
        shares += np.frombuffer(bytes(r.levels), "<i8")
        tokens, vocabulary = tokens + r.total, vocabulary + r.n
    C.release(spark)
    # the head: all words of at least 2**(least - 1) occurrences, as many as fit
    upto = np.cumsum(shares[::-1])[::-1]
    least = next(q for q in range(1, 65) if q == 64 or upto[q] <= head)

    @C.tidy
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")
                own = levels(counts) >= least
                yield pa.RecordBatch.from_arrays([C.packed([keys[own]]), C.packed([counts[own]])], ["keys", "counts"])

    @C.tidy
    def fill(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.trim()
        none = np.zeros(0, np.uint64)
        entries, entry_levels, words, counts = [none], [none.astype(np.int64)], none, none.astype("<i8")
        for batch in group:
            for slot, k, c in zip(*(x.to_pylist() for x in batch.columns[:3]), strict=True):
                keys, n = np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")
                q = levels(n)
                if slot & 1 == 0:
                    own = q < least
                    words, counts, keys, q = keys[own], n[own], keys[own] ^ np.uint64(1), q[own]
                entries.append(keys)
                entry_levels.append(q)
        keys, q = np.concatenate(entries), np.concatenate(entry_levels)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), C.packed([bloom_of(keys, q, bits_per_item).data]), C.packed([words]), C.packed([counts])], ["seg", "bits", "keys", "counts"])

    heads = table.filter("slot % 2 = 0").select("keys", "counts").mapInArrow(top, "keys binary, counts binary").collect()
    keys = np.concatenate([*(np.frombuffer(bytes(r.keys), "<u8") for r in heads), np.zeros(0, np.uint64)])
    counts = np.concatenate([*(np.frombuffer(bytes(r.counts), "<i8") for r in heads), np.zeros(0, np.int64)])
    order = np.argsort(keys)
    segs = table.select("slot", "keys", "counts").withColumn("seg", F.shiftrightunsigned("slot", 1)).groupBy("seg").applyInArrow(fill, "seg long, bits binary, keys binary, counts binary")
    segments, _ = C.store(segs, "segments", tidy_shuffles=True)
    C.discard(spark, table_path)
    C.release(spark)
    keys, counts = keys[order], counts[order]
    return LanguageModel(tokens, vocabulary, keys, counts, seg_bits, segments, int(vocabulary - len(keys)), bloom_of(keys ^ np.uint64(1), levels(counts), bits_per_item))


def score(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, base_score, score (log10).

    Null and empty texts are one end token.  Repeated rows are scored each; null ids stay null.  Without training tokens every count is
    0, N is 0 and V is 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.head_keys, model.head_counts, model.head_filter))
    n, v, seg_bits, has_tail = model.tokens, model.vocabulary, model.seg_bits, model.tail_words > 0
    below = n + ALPHA * (v + 1)

    @C.tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw, offs = C.text_buffer(batch.column(1))
            ids, null = C.long_column(batch.column(0))
            for i, j in C.blocks(offs, C.BLOCK):
                text = pa.compress(pa.py_buffer(np.ascontiguousarray(raw[offs[i] : offs[j]])), "zstd")
                cols = [ids[i:j], null[i:j], np.diff(offs[i : j + 1]), np.frombuffer(text, np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(C.packed([c]) for c in cols)], ["block", "ids", "nulls", "sizes", "text"])
                at += 1

    def tokens_of(sizes: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))])
        return stream(np.frombuffer(pa.decompress(text, int(offsets[-1]), "zstd"), np.uint8), offsets)

    def in_head(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is in the head, and its count there."""
        head_keys, head_counts, _ = shared.value
        if not len(head_keys):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(head_keys, words), len(head_keys) - 1)
        return head_keys[at] == words, np.where(head_keys[at] == words, head_counts[at], 0)

    @C.tidy
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            C.trim()
            for block, sizes, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, before = tokens_of(sizes, text)
                pairs = np.unique(bigrams(tokens, before)[0])
                rows = _dealt(pairs, pairs, 1, seg_bits)
                if has_tail:
                    words = np.unique(tokens)
                    far = words[~in_head(words)[0]]
                    rows += _dealt(far, far, 0, seg_bits)
                keys = C.packed([_narrow(k) if kind else k for kind, _, k, _ in rows])
                yield pa.RecordBatch.from_arrays([pa.array([s for _, s, *_ in rows], pa.int64()), pa.array([kind for kind, *_ in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), keys], ["seg", "kind", "block", "keys"])

    def answer(asked: pa.Table, segment: pa.Table) -> pa.Table:
        C.trim()
        bloom, words, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for data, k, c in zip(*(segment.column(x).to_pylist() for x in ("bits", "keys", "counts")), strict=True):
            data = np.frombuffer(data, np.uint8)
            bloom, words, counts = LogFrequencyBloom(data, 0, (len(data) * 8).bit_length() - 1), np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")
        kinds = asked.column("kind").to_pylist()
        asked_keys = [_widen(k) if kind else np.frombuffer(k, "<u8") for kind, k in zip(kinds, asked.column("keys").to_pylist(), strict=True)]
        sizes = np.cumsum([len(k) for k in asked_keys])[:-1]
        entries, back = np.unique(np.concatenate([*(k if kind else k ^ np.uint64(1) for kind, k in zip(kinds, asked_keys, strict=True)), words[:0]]), return_inverse=True)
        level = bloom.level(entries, np.full(len(entries), 63)) if bloom else np.zeros(len(entries), np.int64)
        found = np.split(level.astype(np.uint8)[back], sizes) if kinds else []
        exact = []
        for kind, keys in zip(kinds, asked_keys, strict=True):
            if kind or not len(words):
                exact.append(np.zeros(0 if kind else len(keys), "<i8"))
            else:
                at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
                exact.append(np.where(words[at] == keys, counts[at], 0).astype("<i8"))
        return pa.table({"block": asked.column("block"), "kind": asked.column("kind"), "seg": asked.column("seg"), "levels": C.packed(found), "counts": C.packed(exact)})

    def sum_up(block: pa.Table, answers: pa.Table) -> pa.Table:
        C.trim()
        ids, null, sizes, text = (block.column(c)[0].as_py() for c in ("ids", "nulls", "sizes", "text"))
        tokens, before = tokens_of(sizes, text)
        pairs, _ = bigrams(tokens, before)
        got = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "seg", "levels", "counts")), strict=True), key=lambda x: x[:2])
        level = [np.frombuffer(b"".join(x[2] for x in got if x[0] == kind), np.uint8) for kind in (0, 1)]
        # the END that opens each document has the count of END
        words, back = np.unique(tokens, return_inverse=True)
        inside, exact = in_head(words)
        rough = np.zeros(len(words))
        rough[inside] = representative(shared.value[2].level(words[inside] ^ np.uint64(1), np.full(int(inside.sum()), 63)))
        if has_tail:
            exact[~inside] = np.frombuffer(b"".join(x[3] for x in got if x[0] == 0), "<i8")
            rough[~inside] = representative(level[0].astype(np.int64))
        end = rough[np.searchsorted(words, END)]
        c = rough[back]
        context = np.empty_like(c)
        context[1:] = c[:-1]
        context[before[:-1]] = end
        pair, where, which = np.unique(pairs, return_index=True, return_inverse=True)
        most = levels(np.maximum(np.minimum(c, context)[where], 0) + 0.5)
        of_pair = representative(np.minimum(level[1].astype(np.int64), most))[which]
        p1 = (c + ALPHA) / below
        logs = np.log10((of_pair + MU * p1) / (context + MU))
        base = np.log10((exact + ALPHA) / below)[back]
        add = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[before])
        doc_id = pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(null, bool))
        known = add((exact > 0)[back].astype(np.float64)).astype(np.int64)
        return pa.table({"doc_id": doc_id, "n_tokens": np.diff(before).astype(np.int64), "n_known": known, "base_score": add(base), "score": add(logs)})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks, _ = C.store(slim.mapInArrow(gather, "block long, ids binary, nulls binary, sizes binary, text binary"), "blocks")
    asks = blocks.select("block", "sizes", "text").mapInArrow(ask, "seg long, kind long, block long, keys binary")
    answers, _ = C.store(asks.groupBy("seg").cogroup(model.segments.groupBy("seg")).applyInArrow(answer, "block long, kind long, seg long, levels binary, counts binary"), "answers", tidy_shuffles=True)
    del asks
    C.release(spark)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sum_up, "doc_id long, n_tokens long, n_known long, base_score double, score double")
