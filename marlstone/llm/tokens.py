"""Token ids in fixed-width bit-packed files.

File format: ``MRLTOK1\\n``, then little-endian int64 ``width, block, n_ids, n_docs, n_blocks``, then ``n_docs`` pairs
``(doc_id, n_tokens)``, ``n_docs`` null flags (one byte each), ``n_blocks`` int64 byte offsets of blocks (from the start of the data),
then the blocks.  A block holds ``block`` ids (the last one fewer) in ``width`` bits each, least significant bit first, padded to
whole 64-bit words, so that any block can be unpacked alone with numpy.  ``width`` is the least that holds the vocabulary.

Encoding splits texts where the pre-tokeniser always splits (before white space that follows a word) and remembers the ids of pieces
by a 64-bit hash, so that the library sees each piece once a worker.  Texts with white space beyond ASCII go to the library whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAGIC = b"MRLTOK1\n"
_WIDE = re.compile("[\u001c-\u001f\u0085\u00a0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]|<\\|")  # white space beyond ASCII, and what may begin a special token


class MemoEncoder:
    """Encodes documents with a tokeniser of the tokenizers library, with a bounded memory of pieces.

    The ids are the library's.  Pieces are told apart by a 64-bit hash: against a full memory a new piece is taken for another with a
    chance of 10**-13.

    leading: white space before a word belongs to its piece (byte-level vocabularies); otherwise white space is dropped.
    """

    LIMIT = 1_500_000
    AT_ONCE = 2048  # texts that go to the library together: what it returns is many times their size

    def __init__(self, path: str, leading: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib, self.leading = Tokenizer.from_file(path), leading
        self.lib.no_padding()
        self.lib.no_truncation()
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for k in range(0, len(texts), self.AT_ONCE) for x in self.lib.encode_batch_fast(texts[k : k + self.AT_ONCE], add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        got = self._library(texts)
        n = np.fromiter(map(len, got), np.int32, len(got))
        at = self.used + np.concatenate([[0], np.cumsum(n[:-1], dtype=np.int64)])
        flat = np.fromiter((i for ids in got for i in ids), np.int32, int(n.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(flat), self.used) + (1 << 16), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        where = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, where, hashes)
        self.at = np.insert(self.at, where, at)
        self.n = np.insert(self.n, where, n)

    def _pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, before = C.word_spans(raw, offsets)
        if not self.leading:
            return starts, ends, before
        doc = np.searchsorted(offsets, starts, "right") - 1
        starts = np.maximum(offsets[doc], np.concatenate([[0], ends[:-1]])) if len(ends) else starts
        tail_at = np.where(before[1:] > before[:-1], ends[np.maximum(before[1:] - 1, 0)] if len(ends) else offsets[:-1], offsets[:-1])
        tails = np.flatnonzero(tail_at < offsets[1:])  # white space that ends a document
        if len(tails):
            starts, ends = np.insert(starts, before[tails + 1], tail_at[tails]), np.insert(ends, before[tails + 1], offsets[tails + 1])
            before = before + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(offsets) - 1), tails))])
        return starts, ends, before

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, number of ids before each document) of UTF-8 documents."""
        ids, counts = [], []
        for i, j in C.blocks(offsets):
            part, offs = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            text = part.tobytes()
            if _WIDE.search(text.decode()):
                odd = [bool(_WIDE.search(text[a:b].decode())) for a, b in zip(offs[:-1], offs[1:], strict=True)]
                for k, is_odd in enumerate(odd):
                    one = part[offs[k] : offs[k + 1]]
                    if is_odd:
                        got = np.array(self._library([one.tobytes().decode()])[0], np.int32)
                    else:
                        got, _ = self._block(one, np.array([0, len(one)]))
                    ids.append(got)
                    counts.append(np.array([len(got)]))
                continue
            got, n = self._block(part, offs)
            ids.append(got)
            counts.append(n)
        before = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64) if counts else np.zeros(1, np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), before

    def _block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, before = self._pieces(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        keys, first, back = np.unique(C.spans_hashed(raw, starts, ends), return_index=True, return_inverse=True)
        text = raw.tobytes()

        def missing() -> np.ndarray:
            if not len(self.keys):
                return np.arange(len(keys))
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            return np.flatnonzero(self.keys[at] != keys)

        new = missing()
        if len(self.keys) + len(new) > self.LIMIT:
            self._clear()
            new = missing()  # all of the block, which always fits for a while
        if len(new):
            self._learn(keys[new], [text[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        at = np.searchsorted(self.keys, keys)
        n, src = self.n[at][back].astype(np.int64), self.at[at][back]
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(src - (stop - n), n) + np.arange(stop[-1])]
        upto = np.concatenate([[0], stop])
        return ids, np.diff(upto[before])


_encoders: dict[tuple[str, bool], MemoEncoder] = {}


def encoder(path: str, leading: bool) -> MemoEncoder:
    """One encoder a worker process."""
    if (path, leading) not in _encoders:
        _encoders.clear()
        _encoders[path, leading] = MemoEncoder(path, leading)
    return _encoders[path, leading]


def with_end(ids: np.ndarray, before: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends end_id to each document."""
    n = len(before) - 1
    return np.insert(ids, before[1:], end_id) if n else ids, before + np.arange(n + 1)


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Fixed-width packing, least significant bit first, whole 64-bit words."""
    n = len(ids)
    if width == 16 and n % 4 == 0:
        return ids.astype("<u2").tobytes()
    bit = np.arange(n, dtype=np.int64) * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    out, v = np.zeros((n * width + 63) // 64 + 1, np.uint64), ids.astype(np.uint64)
    np.bitwise_or.at(out, word, v << shift)
    over = np.flatnonzero(shift + np.uint64(width) > 64)
    np.bitwise_or.at(out, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
    return out[: (n * width + 63) // 64].astype("<u8").tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    words = np.concatenate([np.frombuffer(data, "<u8"), np.zeros(1, np.uint64)])
    bit = np.arange(n, dtype=np.int64) * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    return ((low | high) & np.uint64((1 << width) - 1)).astype(np.uint32)


class TokenFile:
    """Random access to one file: any document or range of ids reads only the blocks that it needs."""

    def __init__(self, uri: str):
        fs, path = C.filesystem(uri)
        self.f = fs.open_input_file(path)
        head = self.f.read_at(48, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.width, self.block, self.n_ids, self.n_docs, self.n_blocks = (int(x) for x in np.frombuffer(head, "<i8", 5, 8))
        rest = self.f.read_at(17 * self.n_docs + 8 * self.n_blocks, 48)
        table = np.frombuffer(rest, "<i8", 2 * self.n_docs).reshape(-1, 2)
        self.doc_ids, self.sizes = table[:, 0], table[:, 1]
        self.null_ids = np.frombuffer(rest, np.uint8, self.n_docs, 16 * self.n_docs).astype(bool)
        self.places = np.frombuffer(rest, "<i8", self.n_blocks, 17 * self.n_docs)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = 48 + len(rest)

    def read(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        out = []
        for b in range(start // self.block, (stop - 1) // self.block + 1):
            n = min(self.block, self.n_ids - b * self.block)
            ids = unpack_bits(self.f.read_at((n * self.width + 63) // 64 * 8, self.data + int(self.places[b])), n, self.width)
            out.append(ids[max(0, start - b * self.block) : stop - b * self.block])
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, budget: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in order; at most about budget ids are held, or one document."""
        k = 0
        while k < self.n_docs:
            j = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + budget, "right")) - 1)
            ids = self.read(int(self.starts[k]), int(self.starts[j]))
            for d in range(k, j):
                yield d, ids[self.starts[d] - self.starts[k] : self.starts[d + 1] - self.starts[k]]
            k = j

    def close(self) -> None:
        self.f.close()


class TokenWriter:
    """Writes one file; blocks go out as they fill, to a side file, so that memory holds the document table only."""

    def __init__(self, uri: str, width: int, block: int):
        self.fs, self.path = C.filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.tmp = f"{self.path}.{os.getpid()}.{os.urandom(4).hex()}"
        self.body = self.fs.open_output_stream(self.tmp + ".body")
        self.width, self.block = width, block
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.places: list[int] = []
        self.rest, self.place, self.n_ids = np.zeros(0, np.int32), 0, 0

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.stack([doc_ids, sizes], 1))
        self.nulls.append(nulls)
        self.n_ids += len(ids)
        ids, at = np.concatenate([self.rest, ids]), 0
        while len(ids) - at >= self.block:
            self._put(ids[at : at + self.block])
            at += self.block
        self.rest = ids[at:]

    def _put(self, ids: np.ndarray) -> None:
        self.places.append(self.place)
        data = pack_bits(ids, self.width)
        self.body.write(data)
        self.place += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        self.body.close()
        docs = np.concatenate(self.docs) if self.docs else np.zeros((0, 2), np.int64)
        nulls = np.concatenate(self.nulls) if self.nulls else np.zeros(0, bool)
        with self.fs.open_output_stream(self.tmp) as out, self.fs.open_input_stream(self.tmp + ".body") as body:
            out.write(MAGIC + np.array([self.width, self.block, self.n_ids, len(docs), len(self.places)], "<i8").tobytes())
            out.write(docs.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + np.array(self.places, "<i8").tobytes())
            while chunk := body.read(1 << 22):
                out.write(chunk)
        self.fs.delete_file(self.tmp + ".body")
        self.fs.move(self.tmp, self.path)  # a task that runs again replaces the same file by the same bytes


def write_tokens(docs: DataFrame, out: str, tokenizer: str, *, leading: bool = True, end_id: int = 2, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int, int]]:
    """Writes the ids of all documents, in ascending order of id (null ids first, equal ids by text), one file a range of ids.

    Returns (range number, path, documents, ids) for each file, in order: one small row a partition.  Null and empty texts hold the
    end id only; no documents give no file.  Columns other than the two named are not read.
    """

    @C.tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file, path, docs_n, ids_n = None, None, "", 0, 0
        number = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                enc, path = encoder(tokenizer, leading), f"{out}/part-{number:06d}.tok"
                file = TokenWriter(path, width_of(max(enc.size, end_id + 1)), block)
            raw, offsets = C.text_buffer(batch.column(1))
            names, nulls = C.long_column(batch.column(0))
            for i, j in C.blocks(offsets, 1 << 23):
                ids, before = with_end(*enc.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), end_id)
                file.add(names[i:j], nulls[i:j], np.diff(before), ids)
                docs_n, ids_n = docs_n + j - i, ids_n + len(ids)
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_pydict({"part": [number], "path": [path], "docs": [docs_n], "ids": [ids_n]})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = slim.repartitionByRange(C.parts(C.gentle(docs.sparkSession)), "id").sortWithinPartitions("id", "text")
    done = ordered.mapInArrow(write, "part long, path string, docs long, ids long")
    return sorted(tuple(r) for r in done.collect())


def read_tokens(spark, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, ids as little-endian uint32)."""
    rows, base = [], 0
    for _, path, _, ids in files:
        rows.append((path, base))
        base += ids

    @C.tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(path)
                crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in f.documents()), np.int64, f.n_docs)
                for a in range(0, f.n_docs, 65536):
                    s = slice(a, a + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids[s], mask=f.null_ids[s]), pa.array(base + f.starts[:-1][s]), pa.array(f.sizes[s]), pa.array(crc[s])], ["doc_id", "start", "n_tokens", "ids_crc32"])
                f.close()

    files_df = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files_df.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
