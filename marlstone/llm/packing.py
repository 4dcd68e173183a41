"""Sum-of-squares online packing of token sequences.

Windows hold ``window`` tokens.  A level array counts the open windows at each fill level; a document's last piece goes to the level
whose change makes the sum of squared counts least (ties: the fuller result).  Whole windows of long documents are cut off first.
Each task packs its own input partition, online, with no shuffle; nothing is exchanged between tasks.

At the end of a partition (or when ``max_open`` windows are open) the open windows are levelled: pieces of the emptiest ones are cut
to fill the fullest ones, so that at most one window stays open, and that one is cut into sequences of 2**i tokens, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoder, with_end

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Online packer; pieces are (doc, start, ids, doc_tokens), finished rows are collected in ``rows``."""

    def __init__(self, window: int, first_sequence: int, max_open: int = 4096):
        self.window, self.sequence, self.max_open = window, first_sequence, max_open
        self.count = np.zeros(window + 1, np.int64)  # open windows at each fill level
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, w, at = len(ids), self.window, 0
        while total - at >= w:
            self._emit([(doc, at, ids[at : at + w], total)])
            at += w
        if at < total:
            self._place((doc, at, ids[at:].copy(), total))

    def _place(self, piece: tuple) -> None:
        size, w, n = len(piece[2]), self.window, self.count
        below = n[1 : w - size + 1]  # levels 1 .. w - size
        change = 2 * (n[1 + size : w + 1] - below) + 2
        if w - size >= 1:
            change[-1] = 1 - 2 * below[-1]
            change = np.where(below > 0, change, np.iinfo(np.int64).max)
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            cost = change[best]
        else:
            best, cost = -1, np.iinfo(np.int64).max
        if cost <= 2 * n[size] + 1:
            level = best + 1
            pieces = self.open[level].pop()
            n[level] -= 1
            self.n_open -= 1
            pieces.append(piece)
            level += size
        else:
            pieces, level = [piece], size
        if level == w:
            self._emit(pieces)
            return
        self.open[level].append(pieces)
        n[level] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self._level(False)

    def _level(self, last: bool) -> None:
        """Fills the fullest open windows with cuts from the emptiest."""
        w = self.window
        full = [(level, p) for level in range(w - 1, 0, -1) for p in self.open[level]]
        self.open, self.n_open = [[] for _ in range(w)], 0
        self.count[:] = 0
        i, j = 0, len(full) - 1
        while i < j:
            level, pieces = full[i]
            while level < w and i < j:
                give_level, giver = full[j]
                doc, start, ids, total = giver.pop()
                take = min(w - level, len(ids))
                rest = len(ids) - take  # the tail of the piece goes, its head stays
                pieces.append((doc, start + rest, ids[rest:], total))
                if rest:
                    giver.append((doc, start, ids[:rest], total))
                level += take
                full[j] = (give_level - take, giver)
                if give_level == take:
                    j -= 1
            full[i] = (level, pieces)
            if level == w:
                self._emit(pieces)
                i += 1
        if i == j:
            level, pieces = full[i]
            if level == w:
                self._emit(pieces)
            elif last:
                self._powers(pieces, level)
            elif level:
                self.open[level].append(pieces)
                self.count[level], self.n_open = 1, 1

    def _powers(self, pieces: list, level: int) -> None:
        for bit in range(level.bit_length() - 1, -1, -1):
            if not level >> bit & 1:
                continue
            need, out = 1 << bit, []
            while need:
                doc, start, ids, total = pieces[0]
                take = min(need, len(ids))
                out.append((doc, start, ids[:take], total))
                need -= take
                if take == len(ids):
                    pieces.pop(0)
                else:
                    pieces[0] = (doc, start + take, ids[take:], total)
            self._emit(out)

    def finish(self) -> None:
        self._level(True)

    def take(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def pack(docs: DataFrame, tokenizer: str, *, leading: bool = False, window: int = 4096, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Null and empty texts have one token, ``end_id``.  Rows are packed as they come: repeated rows are packed each, null ids stay null.
    No documents give no rows.  Sequences are full or hold a power of two tokens.  Other columns are not read.
    """

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 32)

        def rows() -> pa.RecordBatch:
            got = packer.take()
            cols = list(zip(*got, strict=True)) if got else [[]] * 6
            out = {
                "doc_id": pa.array(cols[0], pa.int64()),
                "start": pa.array(cols[1], pa.int64()),
                "length": pa.array([len(x) for x in cols[2]], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cols[2]], pa.int64()),
                "doc_tokens": pa.array(cols[3], pa.int64()),
                "sequence_id": pa.array(cols[4], pa.int64()),
                "offset": pa.array(cols[5], pa.int64()),
            }
            if with_ids:
                flat = np.concatenate([*cols[2], np.zeros(0, np.int32)]).astype(np.int32)
                offs = np.concatenate([[0], np.cumsum([len(x) for x in cols[2]])]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            raw, offsets = C.text_buffer(batch.column(1))
            names, nulls = C.long_column(batch.column(0))
            for i, j in C.blocks(offsets):
                ids, before = with_end(*encoder(tokenizer, leading).encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), end_id)
                for k in range(j - i):
                    packer.add(None if nulls[i + k] else int(names[i + k]), ids[before[k] : before[k + 1]])
                yield rows()
        packer.finish()
        yield rows()

    C.gentle(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return slim.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
