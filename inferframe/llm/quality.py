"""Quality classifier: nearest-neighbour voting with broadcast latent-semantic vectors of labelled documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, documents, held_out, labelled_rows, pieces, text_bytes, trimmed
from .decontaminate import MARKS
from .shingles import SPACE, words

#: Hashed terms: of words, of runs of marks, and of words that stood among the last few.
WORDS, SIGNS, BACK = 4096, 256, 8
TERMS = WORDS + SIGNS + BACK


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    base: np.ndarray  # terms x latent dimensions
    vectors: np.ndarray  # labelled documents, unit length
    y: np.ndarray
    neighbours: int
    prior: float


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Term counts of each text: its words, its runs of ASCII marks, and, in place of a word that stood among the last eight, how far back."""
    n = len(off) - 1
    out = np.zeros((n, TERMS), np.float32)
    _, _, h, w = words(data, off, MARKS)
    doc = np.repeat(np.arange(n), np.diff(w))
    term = (h >> np.uint64(52)).astype(np.int64)
    for lag in range(BACK, 0, -1):
        same = np.flatnonzero((h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])) + lag
        term[same] = WORDS + SIGNS + lag - 1
    _add(out, doc, term)
    _, _, h, w = words(data, off, ~MARKS | SPACE)
    _add(out, np.repeat(np.arange(n), np.diff(w)), WORDS + (h >> np.uint64(56)).astype(np.int64))
    return out


def _add(out: np.ndarray, doc: np.ndarray, term: np.ndarray, rows: int = 256) -> None:
    cut = np.searchsorted(doc, np.arange(0, len(out) + rows, rows))
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        own = out[k * rows : (k + 1) * rows]
        own += np.bincount((doc[a:b] - k * rows) * TERMS + term[a:b], minlength=own.size).reshape(own.shape)


def _weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of shares times inverse frequencies, in place of the counts."""
    c /= np.maximum(c.sum(1, keepdims=True), 1)
    np.sqrt(c, out=c)
    c *= idf
    return c


def _latent(c: np.ndarray, idf: np.ndarray, base: np.ndarray) -> np.ndarray:
    v = _weighted(c, idf) @ base
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)


def train(c: np.ndarray, y: np.ndarray, latent: int = 48, neighbours: int = 25) -> Model:
    """TF-IDF of term counts and a randomised SVD (two power rounds) of the labelled texts."""
    if not len(c):
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), neighbours, 0.5)
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(0))).astype(np.float32)
    a = _weighted(c, idf)
    rng = np.random.default_rng(31)
    q = a.T @ rng.standard_normal((len(a), latent + 8)).astype(np.float32)
    for _ in range(2):
        q, _ = np.linalg.qr(q)
        q = a.T @ (a @ q)
    q, _ = np.linalg.qr(q)
    u, _, _ = np.linalg.svd((a @ q).T, full_matrices=False)
    base = (q @ u[:, :latent]).astype(np.float32)
    v = a @ base
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    return Model(idf, base, v, y.astype(np.float32), neighbours, float(y.mean()))


def vote(v: np.ndarray, m: Model, block: int = 512) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by similarity; exact products in blocks."""
    out = np.full(len(v), m.prior)
    if not len(m.vectors):
        return out
    k = min(m.neighbours, len(m.vectors))
    for lo in range(0, len(v), block):
        s = v[lo : lo + block] @ m.vectors.T
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(s, near, 1), 0).astype(np.float64) ** 8
        total = w.sum(1)
        got = (w * m.y[near]).sum(1) / np.maximum(total, 1e-300)
        out[lo : lo + block] = np.where(total > 1e-12, got, m.prior)
    return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, most_good: int = 2500, most_bad: int = 1000) -> Model:
    """Learn from a bounded sample of labelled documents that aren't held out (crc32 of the id mod 5 is 0).

    Executors count the terms of the whole texts; the driver gets at most TERMS counts of each row of the sample.
    """

    def count(batches):
        for b in pieces(batches):
            c = counts(*text_bytes(column(b, "text")))
            some = [np.flatnonzero(r) for r in c]
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "y"), pa.array([i.astype("<u2").tobytes() for i in some], pa.binary()), pa.array([r[i].tobytes() for i, r in zip(some, c, strict=True)], pa.binary())], ["id", "y", "terms", "counts"])

    chosen = labelled_rows(docs, labels, "quality", {1: most_good, 0: most_bad}, lambda i: ~held_out(i))
    if chosen is None:
        return train(np.zeros((0, TERMS)), np.zeros(0))
    rows = sorted(chosen.mapInArrow(trimmed(count), "id long, y int, terms binary, counts binary").collect(), key=lambda r: r["id"])
    c = np.zeros((len(rows), TERMS), np.float32)
    for own, r in zip(c, rows, strict=True):
        own[np.frombuffer(r["terms"], "<u2")] = np.frombuffer(r["counts"], np.float32)
    return train(c, np.array([r["y"] for r in rows], np.float64))


def _scores(texts, m: Model) -> np.ndarray:
    return vote(_latent(counts(*text_bytes(texts)), m.idf, m.base), m)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, score (0 to 1) of the whole text and predicted (1 if score >= threshold).

    A null or empty text, or one without any known term, scores the share of label 1 in the sample. Repeated rows and null
    ids are scored like others; an empty table gives an empty result; other columns are ignored.
    """
    given = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by the sample's parameters

    def run(batches):
        m = Model(**given.value)
        for b in pieces(batches, rows=1024):
            s = _scores(column(b, "text"), m)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents(docs).mapInArrow(trimmed(run), "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose own text scores at least threshold as score() has it: each row is judged by itself, without a join."""
    given = documents(docs).sparkSession.sparkContext.broadcast(vars(model))
    text = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        m = Model(**given.value)
        for b in batches:
            texts = pc.cast(b.column(text), pa.string())
            one = pa.RecordBatch.from_arrays([texts], ["text"])
            if b.num_rows:
                yield b.filter(pa.array(np.concatenate([_scores(p.column(0), m) for p in pieces([one], rows=1024)]) >= threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)
