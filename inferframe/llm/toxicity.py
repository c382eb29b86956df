"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, distinct, documents, held_out, labelled_sample, pieces, text_bytes, trimmed
from .shingles import LOWER
from .suffix_dedup import gram_hashes

BITS = 20
#: Bytes that end a sentence; a sentence ends behind a run of them.
STOPS = np.zeros(256, bool)
STOPS[[10, 33, 46, 63]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by hash of a 5-byte gram
    bias: float


def sentences(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of sentences in joined texts; each non-empty text begins one."""
    if not len(data):
        return np.zeros(0, np.int64)
    stop = STOPS[data]
    new = np.zeros(len(data), bool)
    new[1:] = stop[:-1] & ~stop[1:]
    new[off[:-1][off[:-1] < len(data)]] = True
    return np.flatnonzero(new)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the 5-byte grams of lower-cased texts that stay in their text."""
    h = (gram_hashes(LOWER[data], (5,))[0] >> np.uint64(64 - BITS)).astype(np.int64) if len(data) >= 5 else np.zeros(0, np.int64)
    whole = np.ones(len(h), bool)
    for k in range(1, 5):
        edge = off[1:-1] - k
        whole[edge[(edge >= 0) & (edge < len(h))]] = False
    at = np.flatnonzero(whole)
    return at, h[at]


def _instances(data, off, weights, window: int = 1 << 20):
    """Sentence starts, the document of each, and the distinct (sentence, gram) pairs whose gram has a weight.

    Sentences are hashed in runs of about window bytes, so that only the pairs of a very long text take memory beside it.
    """
    start = sentences(data, off)
    pairs, lo = [np.zeros(0, np.int64)], 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + window)))
        a, e = int(start[lo]), int(start[hi]) if hi < len(start) else len(data)
        part = data[a : e + 4]  # a gram belongs to the sentence in which it begins
        inner = off[np.searchsorted(off, a, "right") : np.searchsorted(off, a + len(part))] - a
        at, h = grams(part, np.concatenate([[0], inner, [len(part)]]))
        hit = (weights[h] != 0) & (at < e - a)
        s = np.searchsorted(start, at[hit] + a, "right") - 1
        pairs.append(distinct((s << BITS) | h[hit]))
        lo = hi
    pair = np.concatenate(pairs)
    return start, np.searchsorted(off, start, "right") - 1, pair >> BITS, pair & ((1 << BITS) - 1)


def _runs(sizes: list[int], most: int):
    """Ranges of consecutive texts of about most bytes, at least one text each."""
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if sizes:
        yield lo, len(sizes)


def train(texts: list[str], y: np.ndarray, features: int = 4000, rounds: int = 300, l2: float = 1e-3) -> Model:
    """Noisy-or likelihood of document labels, by Adam; features: the grams whose document frequencies differ most by class."""
    weights = np.zeros(1 << BITS, np.float32)
    if not len(texts) or y.min() == y.max():
        return Model(weights, 20.0 if len(y) and y[0] == 1 else -20.0)
    df = np.zeros((2, 1 << BITS), np.float32)
    raw = [t.encode() for t in texts]
    del texts
    for t, c in zip(raw, y, strict=True):
        df[int(c)][distinct(grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1])] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], np.float32)
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    z = odds / np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5))
    z[df[1] < 4] = 0
    best = np.argsort(-z)[:features]
    best = best[z[best] > 3]
    weights[best] = 1
    index = np.zeros(1 << BITS, np.int64)
    index[best] = np.arange(len(best))
    doc, s, g, count = [], [], [], 0
    for lo, hi in _runs([len(t) for t in raw], 1 << 20):  # a run at a time, as hashes take many times the text's memory
        data, off = np.frombuffer(b"".join(raw[lo:hi]), np.uint8), np.append(0, np.cumsum([len(t) for t in raw[lo:hi]]))
        start, own, sentence, gram = _instances(data, off, weights)
        doc.append((own + lo).astype(np.int32)), s.append((sentence + count).astype(np.int32)), g.append(index[gram].astype(np.int32))
        count += len(start)
    doc, s, g = (np.concatenate(x) for x in (doc, s, g))
    w, b = np.clip(odds[best].astype(np.float64), 0, 4), -6.0
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    heard = np.bincount(s, minlength=count) > 0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        x = np.bincount(s, w[g], count) + b
        p = heard / (1 + np.exp(-x))
        none = np.bincount(doc, -np.logaddexp(0, x) * heard, len(raw))
        pull = np.where(y == 1, np.exp(none) / np.maximum(-np.expm1(none), 1e-9), -1.0) * share
        gs = pull[doc] * p
        grad = np.append(np.bincount(g, gs[s], len(w)) - l2 * w / max(1, len(w)), gs.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-10)
        w, b = w + step[:-1], min(b + step[-1], -2.0)  # without evidence against a sentence, none for it
    weights[:] = 0
    weights[best] = w
    return Model(weights, float(b))


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = 1500, most_negative: int = 2500) -> Model:
    """Learn from a bounded sample of labelled documents that aren't held out (crc32 of the id mod 5 is 0)."""
    return train(*labelled_sample(docs, labels, "toxic", {1: most_positive, 0: most_negative}, lambda i: ~held_out(i)))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, score (noisy-or over sentences of the whole text), predicted and sentences array<struct<start, end, score>>, those at or
    above threshold with byte offsets, or the worst one of a text that only its sentences together bring there.

    A null, empty or wordless text has no sentence that can offend and scores 0 (1 if every label learned was toxic). Repeated rows and null ids are scored like others; an
    empty table gives an empty result; other columns are ignored.
    """
    given = docs.sparkSession.sparkContext.broadcast(vars(model))  # 2^20 floats, whatever the corpus

    def run(batches):
        m = Model(**given.value)
        for b in pieces(batches):
            data, off = text_bytes(column(b, "text"))
            start, doc, s, g = _instances(data, off, m.weights)
            x = np.bincount(s, m.weights[g].astype(np.float64), len(start)) + m.bias if len(start) else np.zeros(0)
            if m.bias <= 0:  # a positive bias stands for a model of one class
                x[np.bincount(s, minlength=len(start)) == 0] = -np.inf  # a sentence without any known gram speaks for nothing, however many there are
            total = -np.expm1(np.bincount(doc, -np.logaddexp(0, x), b.num_rows)) if len(start) else np.zeros(b.num_rows)
            if m.bias > 0:
                total[np.diff(off) == 0] = 1
            total = np.clip(total, 0.0, 1.0)
            p, end = 1 / (1 + np.exp(-x)), np.append(start[1:], len(data))
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            offends = p >= threshold
            for d in np.flatnonzero((total >= threshold) & (np.bincount(doc, offends, b.num_rows) == 0)):  # several doubtful sentences: the worst one
                own = np.flatnonzero(doc == d)
                offends[own[p[own].argmax()] if len(own) else []] = True
            for i in np.flatnonzero(offends):
                found[doc[i]].append({"start": int(start[i] - off[doc[i]]), "end": int(end[i] - off[doc[i]]), "score": float(p[i])})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(total), pa.array((total >= threshold).astype(np.int32)), pa.array(found, kind)], ["doc_id", "score", "predicted", "sentences"])

    return documents(docs).mapInArrow(trimmed(run), "doc_id long, score double, predicted int, sentences array<struct<start:long,end:long,score:double>>")
