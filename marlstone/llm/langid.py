"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads text byte by byte in both directions (two GRUs) and gives each position a probability for each language; A-Z are read
as a-z.  A document's probabilities are the mean over all positions of its letters.  It is read in stretches of ``STRETCH`` bytes: each
direction starts ``MARGIN`` bytes before the stretch (at the end of the document at the earliest), so that every position is judged with
what stands on both sides of it, words and sentences alike.  Memory is bounded by the stretches that are read together.

Training (backpropagation through time and Adam, in numpy, on the driver) uses a bounded sample: of at most ``max_labels`` languages
about ``docs_per_language`` different texts each, chosen by a hash of the row, and ``windows_per_doc`` windows of each.  Prediction reads
every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HIDDEN = 8
STRETCH, MARGIN = 512, 32
WINDOW = 48  # bytes of a window of the sample
UND = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes that are, or are part of, letters: only these positions are pooled.
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Model:
    languages: list[str]
    params: dict[str, np.ndarray]


def init(n_languages: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["x" + d] = r.normal(0, 0.3, (256, 3 * hidden))
        p["u" + d] = r.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        p["c" + d] = np.zeros(3 * hidden)
        p["o" + d] = r.normal(0, hidden**-0.5, (hidden, n_languages))
    p["bias"] = np.zeros(n_languages)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(p: dict, d: str, codes: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction at each position [T, B, H]; codes [T, B]."""
    t_max, n = codes.shape
    h_size = p["u" + d].shape[0]
    h, out, tape = np.zeros((n, h_size), np.float32), np.zeros((t_max, n, h_size), np.float32), []
    for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
        x = p["x" + d][codes[t]] + p["c" + d]
        u = h @ p["u" + d]
        zr = _sigmoid(x[:, : 2 * h_size] + u[:, : 2 * h_size])
        z, r = zr[:, :h_size], zr[:, h_size:]
        un = u[:, 2 * h_size :]
        c = np.tanh(x[:, 2 * h_size :] + r * un)
        m = mask[t][:, None]
        new = h + m * (1 - z) * (c - h)
        if keep:
            tape.append((t, h, z, r, un, c))
        out[t] = h = new
    return out, tape


def forward(p: dict, codes: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Probabilities at each position [T, B, languages]."""
    f, tf = _run(p, "f", codes, mask, keep)
    b, tb = _run(p, "b", codes, mask, keep)
    logits = f @ p["of"] + b @ p["ob"] + p["bias"]
    logits -= logits.max(-1, keepdims=True)
    e = np.exp(logits)
    prob = e / e.sum(-1, keepdims=True)
    return prob, (f, b, tf, tb)


def gradients(p: dict, codes: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over positions and its gradients, by backpropagation through time."""
    prob, (f, b, tf, tb) = forward(p, codes, mask, True)
    total, (t_max, n) = float(mask.sum()), codes.shape
    picked = prob[:, np.arange(n), labels]
    loss = float(-(np.log(picked + 1e-9) * mask).sum() / total)
    d_out = prob.copy()
    d_out[:, np.arange(n), labels] -= 1
    d_out *= mask[:, :, None] / np.float32(total)
    g = {"bias": d_out.sum((0, 1))}
    one_hot = np.zeros((t_max * n, 256), np.float32)
    one_hot[np.arange(t_max * n), codes.ravel()] = 1
    for d, states, tape in (("f", f, tf), ("b", b, tb)):
        h_size = states.shape[2]
        g["o" + d] = states.reshape(-1, h_size).T @ d_out.reshape(-1, d_out.shape[2])
        d_states = d_out @ p["o" + d].T
        dx = np.zeros((t_max, n, 3 * h_size), np.float32)
        du, dh = np.zeros_like(p["u" + d]), np.zeros((n, h_size), np.float32)
        for t, h, z, r, un, c in reversed(tape):
            dh = dh + d_states[t]
            m = mask[t][:, None]
            dc = dh * m * (1 - z) * (1 - c * c)
            dz = dh * m * (h - c) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dc], 1)
            d_u = np.concatenate([dz, dr, dc * r], 1)
            du += h.T @ d_u
            dh = dh * (1 - m * (1 - z)) + d_u @ p["u" + d].T
        flat = dx.reshape(-1, 3 * h_size)
        g["x" + d], g["c" + d], g["u" + d] = one_hot.T @ flat, flat.sum(0), du
    return loss, g


def matrix(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and mask [T, B] of pieces."""
    t_max = max(map(len, pieces))
    flat = np.frombuffer(b"".join(x.ljust(t_max, b"\0") for x in pieces), np.uint8).reshape(len(pieces), t_max)
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.ascontiguousarray(flat.T), (np.arange(t_max)[:, None] < lens[None]).astype(np.float32)


def train(pieces: list[bytes], labels: np.ndarray, languages: list[str], *, steps: int = 160, batch: int = 128, rate: float = 0.03, seed: int = 11) -> Model:
    """Adam on balanced batches of pieces; deterministic for given pieces in given order."""
    p, r = init(len(languages)), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    by = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        at = np.concatenate([r.choice(x, max(1, batch // len(by))) for x in by])
        codes, mask = matrix([pieces[i] for i in at])
        _, g = gradients(p, codes, mask, labels[at])
        lr = rate * min(1, step / 20) * (1 - step / (steps + 1))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, p)


def held_out(doc_id, folds: int = 5) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def _windows(text: np.ndarray, n: int) -> list[bytes]:
    """At most n windows of a text, at equal distances, with letters in them."""
    starts = np.unique(np.linspace(0, max(0, len(text) - WINDOW), n).astype(np.int64))
    return [w.tobytes() for w in (text[s : s + WINDOW] for s in starts) if _LETTERS[w].any()]


def fit(docs: DataFrame, *, docs_per_language: int = 400, windows_per_doc: int = 8, max_labels: int = 200, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Trains on rows outside the held-out fold with a label and a text; None if there are none, or no column of labels.

    Rows that repeat id and text count once.  Of more than ``max_labels`` labels the most frequent are learned (ties: in order of name).
    """
    if label_col.lower() not in (c.lower() for c in docs.columns):
        return None
    spark = C.gentle(docs.sparkSession)
    flat, (id_at, text_at, label_at) = C.flattened(docs, id_col, text_col, label_col)
    rows = flat.select(F.col(f"c{id_at}").alias("id"), F.col(f"c{text_at}").alias("text"), F.col(f"c{label_at}").cast("string").alias("label")).filter(F.col("label").isNotNull() & (F.col("text") != "") & ~held_out(F.col("id")))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    counts = rows.groupBy("label").agg(F.approx_count_distinct("key").alias("n")).orderBy(F.desc("n"), "label").limit(max_labels).collect()
    if not counts:
        return None
    shares = spark.createDataFrame([(r.label, int(min(1.0, docs_per_language / max(r.n, 1)) * 2**30)) for r in counts], "label string, share long")
    chosen = rows.join(F.broadcast(shares), "label").filter(F.pmod("key", F.lit(2**30)) < F.col("share")).dropDuplicates(["label", "key"])

    @C.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = C.text_buffer(batch.column(0))
            pieces, labels = [], []
            for i, label in enumerate(batch.column(1).to_pylist()):
                own = _windows(C.LOWER[raw[offs[i] : offs[i + 1]]], windows_per_doc)
                pieces += own
                labels += [label] * len(own)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(pieces, pa.binary()), "label": pa.array(labels, pa.string())})

    got = sorted((bytes(r.piece), r.label) for r in chosen.select("text", "label").mapInArrow(cut, "piece binary, label string").collect())
    if not got:
        return None
    languages = sorted({label for _, label in got})
    number = {x: i for i, x in enumerate(languages)}
    return train([x for x, _ in got], np.array([number[x] for _, x in got]), languages)


class Reader:
    """Reads documents with a model; weights are kept in the form that reading needs: gates of half the argument, biases added, and one
    column a sequence, so that every step works on whole rows of memory."""

    def __init__(self, model: Model):
        p, self.n = model.params, len(model.languages)
        h = p["uf"].shape[0]
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
        turned = lambda x: np.ascontiguousarray(x.T.astype(np.float32))
        self.h = h
        self.x = {d: turned((p["x" + d] + p["c" + d]) * half) for d in "fb"}
        self.u = {d: turned(p["u" + d] * half) for d in "fb"}
        self.o = {d: turned(p["o" + d]) for d in "fb"}
        self.bias = p["bias"]
        self.together = max(32, min(512, 4096 // self.n))

    def _logits(self, d: str, codes: np.ndarray) -> np.ndarray:
        """[T, languages, B] of sequences that start at 0; what follows the end of one is of no meaning."""
        t_max, n = codes.shape
        h, x_of, u_of = self.h, self.x[d], self.u[d]
        states, now = np.empty((t_max, h, n), np.float32), np.zeros((h, n), np.float32)
        x, u, gates, c = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((2 * h, n), np.float32), np.empty((h, n), np.float32)
        for t in range(t_max):
            np.take(x_of, codes[t], axis=1, out=x, mode="clip")
            np.matmul(u_of, now, out=u)
            np.add(x[: 2 * h], u[: 2 * h], out=gates)
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            np.multiply(gates[h:], u[2 * h :], out=c)
            c += x[2 * h :]
            np.tanh(c, out=c)
            new = states[t]
            np.subtract(now, c, out=new)
            new *= gates[:h]
            new += c
            now = new
        return np.matmul(self.o[d], states)

    def _stretches(self, raw: np.ndarray, start: np.ndarray, first: np.ndarray, last: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sums [stretches, languages + 1] over the letters at [first, last), read from start to end."""
        size = end - start
        t_max = int(size.max())
        steps = np.arange(t_max)[:, None]
        top = len(raw) - 1
        place = np.minimum(start + steps, top)
        codes = raw[place]
        use = (place >= first) & (start + steps < last) & _LETTERS[codes]
        ahead = self._logits("f", codes)
        back = self._logits("b", raw[np.clip(end - 1 - steps, 0, top)])
        turn = np.clip(size - 1 - steps, 0, t_max - 1)[:, None]
        ahead += np.take_along_axis(back, np.broadcast_to(turn, back.shape), axis=0)
        ahead += self.bias[:, None]
        ahead -= ahead.max(1, keepdims=True)
        np.exp(ahead, out=ahead)
        ahead *= (use / ahead.sum(1))[:, None]
        return np.concatenate([ahead.sum(0), use.sum(0)[None]]).T

    def pool(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[documents, languages + 1]: sums of probabilities over letter positions, and the number of these."""
        out = np.zeros((len(offsets) - 1, self.n + 1), np.float64)
        if not len(raw):
            return out
        n = -(-np.diff(offsets) // STRETCH)
        doc = np.repeat(np.arange(len(n)), n)
        first = offsets[doc] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        last = np.minimum(first + STRETCH, offsets[doc + 1])
        start, end = np.maximum(first - MARGIN, offsets[doc]), np.minimum(last + MARGIN, offsets[doc + 1])
        order = np.argsort(end - start, kind="stable")
        for k in range(0, len(order), self.together):
            own = order[k : k + self.together]
            a, b = int(start[own].min()), int(end[own].max())
            sums = self._stretches(raw[a:b], start[own] - a, first[own] - a, last[own] - a, end[own] - a)
            np.add.at(out, doc[own], sums)
        return out


def answers(model: Model | None, batch: pa.RecordBatch, col: int) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a batch."""
    n = batch.num_rows
    if model is None or not n:
        return [UND] * n, np.zeros(n)
    reader = Reader(model)
    raw, offs = C.text_buffer(batch.column(col))
    best, score, sure = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
    for i, j in C.blocks(offs):
        part, own = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        sums = reader.pool(C.LOWER[part], own)
        best[i:j] = sums[:, :-1].argmax(1)
        score[i:j] = sums[np.arange(j - i), best[i:j]] / np.maximum(sums[:, -1], 1)
        letters = np.flatnonzero(_ASCII[part])
        sure[i:j] = np.searchsorted(letters, own[1:]) > np.searchsorted(letters, own[:-1])
    for i in np.flatnonzero(~sure):
        sure[i] = bool(_LETTER.search(raw[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
    return [model.languages[b] if s else UND for b, s in zip(best.tolist(), sure.tolist(), strict=True)], np.clip(np.where(sure, score, 0), 0, 1)


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (mean probability of lang_pred over letter positions).

    ``und`` with score 0 for a null text, one without any letter, or when there is no model.  Equal probabilities: the first language in
    order.  Repeated rows give repeated rows, null ids stay null, an empty table gives no rows; other columns are not read.
    """

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = answers(model, batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    C.gentle(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, *, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is not ``und`` and has at least the given score; all rows if there is no model."""
    if model is None:
        return docs
    C.gentle(docs.sparkSession)
    flat, (at,) = C.flattened(docs, text_col)

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = answers(model, batch, at)
            yield batch.filter(pa.array([x != UND and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return flat.mapInArrow(run, flat.schema).toDF(*docs.columns)
