"""Language ID by error-correcting output codes over hashed n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, column, documents, held_out, pieces, saved, text_bytes, trimmed
from .shingles import LOWER
from .suffix_dedup import gram_hashes

TERMS = 4096


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # (terms + 1) x bits


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """The exhaustive code (2^(n-1) - 1 bits, every two words 2^(n-2) apart) up to 6 languages; beyond, the best of 200 random codes of 12 log2 n bits."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        cols = [(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(12 * np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        c = rng.choice((-1.0, 1.0), (n, bits))
        c = c[:, np.abs(c.sum(0)) < n]
        d = ((c[:, None] != c[None]).sum(2) + n * bits * np.eye(n)).min()
        if d > apart:
            best, apart = c, d
    return best


def features(data: np.ndarray, off: np.ndarray, window: int = 1 << 20) -> np.ndarray:
    """Square roots of the shares of hashed 2- and 3-byte grams of the lower-cased text, unit length, and a constant."""
    n = len(off) - 1
    out = np.zeros((n, TERMS + 1), np.float32)
    for size in (2, 3):
        for lo in range(0, max(0, len(data) - size + 1), window):
            part = LOWER[data[lo : lo + window + size - 1]]
            if len(part) < size:
                continue
            h = (gram_hashes(part, (size,))[0] >> np.uint64(52)).astype(np.int64)
            at = np.arange(lo, lo + len(h))
            doc = np.searchsorted(off, at, "right") - 1
            ok = at + size <= off[1:][doc]
            first, last = int(doc[0]), int(doc[-1]) + 1
            got = np.bincount((doc[ok] - first) * TERMS + h[ok], minlength=(last - first) * TERMS)
            out[first:last, :TERMS] += got.reshape(-1, TERMS)
    total = out.sum(1, keepdims=True)
    out = np.sqrt(out / np.maximum(total, 1))
    out[:, TERMS] = 0.1
    return out


def train(x: np.ndarray, langs: list[str], rounds: int = 150, l2: float = 1e-4) -> Model:
    """One logistic classifier for each bit of the codewords, over rows of features, all at once, by accelerated gradient steps; languages weigh the same."""
    names = sorted(set(langs))
    code = codewords(len(names))
    if not names:
        return Model([], code, np.zeros((TERMS + 1, 1), np.float32))
    place = {x: i for i, x in enumerate(names)}
    y = np.array([place[x] for x in langs])
    target = code[y].astype(np.float32)
    share = (1 / np.bincount(y)[y] / len(names)).astype(np.float32)[:, None]
    w = np.zeros((TERMS + 1, code.shape[1]), np.float32)
    look, rate = w.copy(), 3.5
    for t in range(rounds):
        grad = x.T @ (share * target / (1 + np.exp(np.clip(target * (x @ look), -60, 60)))) - l2 * look
        new = look + rate * grad
        look = new + t / (t + 3) * (new - w)
        w = new
    return Model(names, code, w)


def fit(docs: DataFrame, per_language: int = 900, most: int = 6000) -> Model:
    """Learn from a bounded sample of the documents that aren't held out: of each language at most per_language rows, and so many that
    all languages together have about most, but at least one; so every language is learned. Rows are chosen by a hash.

    Executors turn the whole texts into features; the driver gets at most 4,097 numbers of each row of the sample.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id"), 4, 2))
    counted = saved(rows.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "l"), "languages")
    quota = min(per_language, max(1, most // max(1, counted.count())))
    # a hash thins each language to about four times its quota before rows are ranked, so that no language is sorted whole
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit("lang")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    thin = rows.join(counted, F.col("lang") == F.col("l")).where(unit < F.lit(4.0 * quota + 30) / F.col("n"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id")
    chosen = thin.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota).select("text", "lang")

    def turned(batches):
        for b in pieces(batches, rows=512):
            x = features(*text_bytes(column(b, "text")))
            some = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays([column(b, "lang"), pa.array([i.astype("<u2").tobytes() for i in some], pa.binary()), pa.array([r[i].tobytes() for i, r in zip(some, x, strict=True)], pa.binary())], ["lang", "terms", "values"])

    got = sorted(chosen.mapInArrow(trimmed(turned), "lang string, terms binary, values binary").collect())
    x = np.zeros((len(got), TERMS + 1), np.float32)
    for own, r in zip(x, got, strict=True):
        own[np.frombuffer(r["terms"], "<u2")] = np.frombuffer(r["values"], np.float32)
    return train(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model, margin: float = 0.5) -> DataFrame:
    """Per row: doc_id, lang_pred, score (share of the nearest codeword under logistic loss) and ambiguous (score of the best
    less that of the next is under margin).

    lang_pred is "und", with score 0, if the text is null or has no letter, or if nothing was learned. Repeated rows and null
    ids are treated like others; an empty table gives an empty result; other columns are ignored.
    """
    given = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        m = Model(**given.value)
        for b in pieces(batches, rows=1024):
            f = features(*text_bytes(column(b, "text"))) @ m.weights
            # a letter is a character of the Unicode categories Lu, Ll, Lt, Lm and Lo
            known = np.asarray(pc.fill_null(pc.match_substring_regex(column(b, "text"), r"\p{L}"), False).to_numpy(zero_copy_only=False), bool) & bool(m.languages)
            if m.languages:
                loss = np.stack([np.logaddexp(0, -f * c).sum(1) for c in m.code], 1).astype(np.float64)
                p = np.exp(loss.min(1, keepdims=True) - loss)
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                top = np.sort(p, 1)
                gap = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)
                names, s = [m.languages[i] for i in best], p.max(1)
            else:
                names, s, gap = [""] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
            names = [x if k else "und" for x, k in zip(names, known, strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, s, 0.0)), pa.array(~known | (gap < margin))], ["doc_id", "lang_pred", "score", "ambiguous"])

    return documents(docs).mapInArrow(trimmed(run), "doc_id long, lang_pred string, score double, ambiguous boolean")
