"""Benchmark decontamination by latent semantic retrieval: a distributed randomised SVD of TF-IDF passages, a cosine search,
then longest-common-subsequence and answer checks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, distinct, documents, ints, pieces, places, saved, shuffles_go, text_bytes, trimmed
from .shingles import SPACE, words

MARKS = SPACE.copy()
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    MARKS[_c] = True
#: Benchmark words that one pass over the corpus looks up (8 bytes each, broadcast); more items take more passes.
PASS_WORDS = 2_000_000
#: Hashed terms of the passages' vocabulary.
BITS = 13
TERMS = 1 << BITS
#: Words that a task of the SVD's products reads, where these are more tasks than two for each core.
FIT_WORDS = 1 << 25
#: Parts, by term, in which the tasks' products are summed.
FIT_PARTS = 8


@dataclass(frozen=True)
class Settings:
    """half: words of half a passage; part: words of an item in one query; rank: latent dimensions, after the skip leading ones, which tell
    languages and styles apart and not passages; rounds: of the SVD's power iteration; cosine: least for a candidate; lcs: share of an item's words in order that makes a match, or near
    with the whole answer."""

    half: int = 32
    part: int = 48
    rank: int = 64
    skip: int = 32
    rounds: int = 2
    cosine: float = 0.9
    lcs: float = 0.75
    near: float = 0.6


def lcs_length(masks: dict[int, int], size: int, seq) -> int:
    """Length of the longest common subsequence of seq and the item whose positions masks gives by word, bit-parallel."""
    full = (1 << size) - 1
    v = full
    for x in seq:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _masks(seq) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(seq):
        out[x] = out.get(x, 0) | 1 << i
    return out


def answer_words(text: str) -> str:
    """What follows the last question mark or "answer:", else the last sentence."""
    low = text.lower().rstrip()
    for mark in ("answer:", "?"):
        at = low.rfind(mark)
        if at >= 0 and low[at + len(mark) :].strip():
            return text[at + len(mark) :]
    body = low.rstrip(".!? \n")
    return text[max(body.rfind(c) for c in ".!?\n") + 1 :]


@dataclass(frozen=True)
class Items:
    """The items of one pass, as arrays: words are places in the vocabulary of all items."""

    ids: np.ndarray
    vocabulary: np.ndarray  # ascending word hashes
    seqs: list[list[int]]
    answers: list[list[int]]
    size: np.ndarray  # words
    least: np.ndarray  # words in order that a match takes at least
    member: np.ndarray  # item * words of the vocabulary + word, ascending
    queries: np.ndarray  # terms of the parts, one after another
    cuts: np.ndarray
    owner: np.ndarray  # item of each part

    @staticmethod
    def of(items: list[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> Items:
        vocabulary = np.unique(np.concatenate([x[1] for x in items]))
        seqs, answers = ([np.searchsorted(vocabulary, x[k]) for x in items] for k in (1, 2))
        size = np.array([len(x) for x in seqs])
        has = np.array([len(x) > 0 for x in answers])
        least = np.ceil(np.where(has, min(s.lcs, s.near), s.lcs) * size - 1e-9).astype(np.int64)
        member = distinct(np.concatenate([k * len(vocabulary) + x for k, x in enumerate(seqs)]))
        parts = [(k, x) for k, (_, t, _) in enumerate(items) for x in np.array_split(t, -(-len(t) // s.part))]
        terms = np.concatenate([x for _, x in parts]) >> np.uint64(64 - BITS)
        return Items(np.array([x[0] for x in items]), vocabulary, [x.tolist() for x in seqs], [x.tolist() for x in answers], size, np.maximum(least, 1), member, terms.astype(np.int64), np.append(0, np.cumsum([len(x) for _, x in parts])), np.array([k for k, _ in parts]))

    def postings(self, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where the items of each word begin, items, how many of its listed words an item takes): the rarest words of each item.

        A match has least[k] words of item k. Of its size - least + j rarest words (with repeats) it then has at least j; j is a third of least.
        """
        take, pairs = np.maximum(1, self.least // 3), []
        for k, seq in enumerate(self.seqs):
            x = np.array(seq)
            rarest = x[np.argsort(df[x], kind="stable")][: len(x) - self.least[k] + take[k]]
            pairs.append(distinct(rarest) * len(self.seqs) + k)
        pairs = np.sort(np.concatenate(pairs))
        word = pairs // len(self.seqs)
        return np.searchsorted(word, np.arange(len(self.vocabulary) + 1)), pairs % len(self.seqs), take


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pairs of a document and a benchmark item whose text it holds, verbatim or paraphrased.

    docs has doc_id and text, benchmark item_id long and text. Words are lower-cased runs without ASCII marks. A window is twice as many words
    as an item has, from every quarter of its length on. An item matches a window if their longest common subsequence has settings.lcs of the item's words, or
    settings.near of them and all of its answer (answer_words) in order.

    Candidates come from two searches over every passage of every whole text:

    1. Latent semantic retrieval. A passage (two halves of settings.half words, each half in two passages) is the TF-IDF vector of its
       words, hashed to 2^13 terms; inverse frequencies count all halves of the corpus. A randomised SVD with power rounds, summed over the cluster, is fitted
       on all passages; each passage is projected to settings.rank dimensions and compared with the parts of all items by
       cosine. A candidate counts on if the text around it has as many of the item's words as a match needs.
    2. An exact rule, as a latent space of few dimensions can't tell rare words apart: a match needs so many words of an item that it has some of the
       item's rarest words; every stretch of text that has them is a candidate. No match is missed, whatever its cosine.

    Returns doc_id, item_id, cosine (of the passages around the best window, latent), lcs_ratio, answer boolean: one row for each pair found.
    Null or wordless texts on either side match nothing; null ids match nothing; repeated rows give the same pairs once; rows that share an item_id
    are variants of it; empty tables give an empty result. Other columns are ignored.
    """
    s = settings
    docs = documents(docs).where(F.col("doc_id").isNotNull())
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    total = bench.agg(F.sum(F.size(F.split("text", r"\s+")).cast("long"))).first()[0] or 0
    passes = max(1, math.ceil(total / PASS_WORDS))
    out = docs.sparkSession.createDataFrame([], SHAPE)
    for turn in range(passes):
        rows = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn).orderBy("item_id", "text").collect()
        hashed = [(r["item_id"], _hashes(r["text"]), _hashes(answer_words(r["text"]))) for r in rows]
        hashed = [x for x in hashed if len(x[1])]
        if hashed:
            out = out.union(_search(docs, Items.of(hashed, s), s))
    best = F.max(F.struct("lcs_ratio", "cosine", "answer")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best, F.max("answer").alias("answer")).select("doc_id", "item_id", "best.cosine", "best.lcs_ratio", "answer")


SHAPE = "doc_id long, item_id long, cosine double, lcs_ratio double, answer boolean"


def _hashes(text: str) -> np.ndarray:
    raw = text.encode()
    return words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), MARKS)[2]


def _halves(n: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(first half of each row and their number, first word of each half and the number of words) of rows of n words."""
    size = -(-n // half)
    base = np.append(0, np.cumsum(size))
    row = np.repeat(np.arange(len(n)), size)
    at = np.append(0, np.cumsum(n))
    return base, np.append(at[row] + (np.arange(len(row)) - base[row]) * half, at[-1])


def _passages(base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last half) of each passage: two halves that follow each other, or a row's only one."""
    first = np.ones(base[-1], bool)
    size = np.diff(base)
    first[base[1:][size > 1] - 1] = False
    first = np.flatnonzero(first)
    lone = np.isin(first, base[:-1][size == 1])
    return first, first + ~lone


def _terms(b) -> np.ndarray:
    return text_bytes(column(b, "terms"))[0].view(np.uint16)


def _sums(x: np.ndarray, rows: np.ndarray, size: np.ndarray, run: int = 32, block: int = 256) -> np.ndarray:
    """Sums of x[rows] over the first size[0] rows, the next size[1] and so on (sizes above 0): many runs side by side, the longest first, which is
    several times as fast as add.reduceat; then the sums of runs likewise."""
    while True:
        runs = -(-size // run)
        begin = places(np.zeros(len(runs), np.int64), runs) * run
        at, length = begin + np.repeat(np.cumsum(size) - size, runs), np.minimum(np.repeat(size, runs) - begin, run)
        order = np.argsort((run - length).astype(np.uint16), kind="stable")
        out, (total, part) = np.empty((len(at), x.shape[1]), x.dtype), np.empty((2, block, x.shape[1]), x.dtype)
        for lo in range(0, len(at), block):
            some = order[lo : lo + block]
            first, n = at[some], length[some]
            to = np.take(x, rows[first], axis=0, out=total[: len(some)], mode="clip")
            longer = len(some) - np.searchsorted(n[::-1], np.arange(n[0]), "right")
            for k, m in enumerate(longer[1:].tolist(), 1):
                to[:m] += np.take(x, rows[first[:m] + k], axis=0, out=part[:m], mode="clip")
            out[some] = to
        if len(out) == len(size):
            return out
        x, rows, size = out, np.arange(len(out)), runs


def _search(docs: DataFrame, items: Items, s: Settings) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    given = sc.broadcast(items.vocabulary)
    bits = 20

    def compact(batches):
        known = given.value
        near = np.zeros(1 << bits, bool)  # most words are ruled out by their first bits
        near[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
        for b in pieces(batches):
            _, _, h, w = words(*text_bytes(column(b, "text")), MARKS)
            may = np.flatnonzero(near[(h >> np.uint64(64 - bits)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, h[may]), len(known) - 1)
            hit = known[at] == h[may]
            where, ids = may[hit], at[hit].astype(np.uint32)
            row = np.searchsorted(w, where, "right") - 1
            pos, cut, term = (where - w[row]).astype(np.uint32), np.searchsorted(where, w), (h >> np.uint64(64 - BITS)).astype(np.uint16)
            cols = [[v[x:y].tobytes() for x, y in zip(c[:-1], c[1:], strict=True)] for v, c in ((term, w), (pos, cut), (ids, cut))]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(np.diff(w)), *(pa.array(v, pa.binary()) for v in cols)], ["doc_id", "n_words", "terms", "places", "ids"])

    table = saved(docs.mapInArrow(trimmed(compact), "doc_id long, n_words long, terms binary, places binary, ids binary").where("n_words > 0"), "benchmark-words")
    idf, n = _frequencies(table, s)
    given.destroy()

    def often(batches):
        n = np.zeros(len(items.vocabulary), np.int64)
        for b in pieces(batches, column="ids"):
            n += np.bincount(text_bytes(column(b, "ids"))[0].view(np.uint32), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["word", "n"])

    count = np.zeros(len(items.vocabulary))
    for r in table.select("ids").mapInArrow(trimmed(often), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # bounded by the vocabulary
        count[r["word"]] = r["n"]
    base = _fit(_all_terms(table, s, n), idf, s)
    scaled = (base * idf[:, None]).astype(np.float32)
    latent = np.add.reduceat(scaled[items.queries], items.cuts[:-1], axis=0)
    latent /= np.maximum(np.sqrt((latent * latent).sum(1, keepdims=True)), 1e-9)
    asked = sc.broadcast((items, scaled, latent, items.postings(count)))
    result = saved(table.mapInArrow(trimmed(lambda batches: _found(batches, *asked.value, s)), SHAPE), "contaminated")
    discard(table)
    return result


def _frequencies(table: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """(inverse frequency of each term, number of halves), over all halves of the corpus."""

    def run(batches):
        df, n = np.zeros(TERMS, np.int64), 0
        for b in pieces(batches, column="terms"):
            base, start = _halves(ints(b, "n_words"), s.half)
            half = np.repeat(np.arange(base[-1], dtype=np.int64), np.diff(start))
            df += np.bincount(distinct(half << BITS | _terms(b)) & (TERMS - 1), minlength=TERMS)
            n += int(base[-1])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["term", "n"])

    df = {r["term"]: r["n"] for r in table.select("n_words", "terms").mapInArrow(trimmed(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most TERMS rows
    n = df.pop(-1, 0)
    out = np.full(TERMS, math.log(n + 1.0))
    for t, d in df.items():
        out[t] = math.log((n + 1) / (d + 1))
    return np.maximum(out, 0.01), n


def _all_terms(table: DataFrame, s: Settings, halves: int) -> DataFrame:
    """The terms of every text, 2 bytes a word, in few partitions, as each makes a matrix."""
    return table.select("terms").coalesce(min(1 << 20, max(2 * table.sparkSession.sparkContext.defaultParallelism, halves * s.half // FIT_WORDS)))


_sample = _all_terms  # the name from when the SVD was fitted on a sample; tests use it


def _fit(texts: DataFrame, idf: np.ndarray, s: Settings) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the TF-IDF matrix A of all passages of texts: power rounds of A^T A on a random start, then Ritz vectors.

    A round reads every text once: halves are summed first, then passages. Each task makes one matrix of terms x (skip + rank + 16) floats; a few
    tasks sum a part of its terms each, and the driver gets the sums.
    """
    spark, width, weight = texts.sparkSession, s.skip + s.rank + 16, idf.astype(np.float32)[:, None]
    tall = TERMS // FIT_PARTS
    q = np.random.default_rng(5).standard_normal((TERMS, width)).astype(np.float32)
    for turn in range(s.rounds + 1):
        q = np.linalg.qr(q)[0].astype(np.float32)
        given = spark.sparkContext.broadcast(q * weight)

        def product(batches):
            total = None
            for b in pieces(batches, column="terms"):
                data, off = text_bytes(column(b, "terms"))
                if not len(data):
                    continue
                total = np.zeros((TERMS, width)) if total is None else total
                t = data.view(np.uint16)
                base, start = _halves(np.diff(off) // 2, s.half)
                z, (first, last) = _sums(given.value, t, np.diff(start)), _passages(base)  # noqa: B023
                both = z[first]
                both[last > first] += z[last[last > first]]
                z[:] = 0
                z[first] = both
                z[last[last > first]] += both[last > first]
                count = np.bincount(t, minlength=TERMS)
                some = np.flatnonzero(count)
                total[some] += _sums(z, np.repeat(np.arange(len(z)), np.diff(start))[np.argsort(t, kind="stable")], count[some])
            if total is not None:
                parts = [x.tobytes() for x in np.split(total.astype(np.float32), FIT_PARTS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(FIT_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "sum"])

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for part, x in zip(ints(b, "part").tolist(), column(b, "sum"), strict=True):
                    total[part] = total.get(part, 0) + np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["part", "sum"])

        shape = "part int, sum binary"
        with shuffles_go(spark):
            got = texts.mapInArrow(trimmed(product), shape).repartition(FIT_PARTS, "part").mapInArrow(trimmed(add), shape).collect()
        given.destroy()
        y = np.zeros((TERMS, width), np.float32)
        for r in got:
            y[r["part"] * tall : (r["part"] + 1) * tall] = np.frombuffer(r["sum"], np.float32).reshape(tall, width)
        y *= weight
        if turn < s.rounds:
            q = y
    _, u = np.linalg.eigh(q.T.astype(np.float64) @ y)
    return (q @ u[:, ::-1][:, s.skip : s.skip + s.rank]).astype(np.float32)


def _latent(b, scaled: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit latent vectors of the passages of a batch, first half of each, first half of each row)."""
    base, start = _halves(ints(b, "n_words"), s.half)
    z = _sums(scaled, _terms(b), np.diff(start))
    first, last = _passages(base)
    both = z[first] + np.where((last > first)[:, None], z[last], 0)
    return both / np.maximum(np.sqrt((both * both).sum(1, keepdims=True)), 1e-9), first, base


def _held(k: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, items: Items, most: int = 1 << 20):
    """In runs of candidates: (the run, candidate and word of those words from lo to hi that the candidate's item has)."""
    size = np.cumsum(hi - lo)
    a = 0
    while a < len(k):
        e = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most)))
        at, of = places(lo[a:e], (hi - lo)[a:e]), np.repeat(np.arange(a, min(e, len(k))), (hi - lo)[a:e])
        key = k[of] * len(items.vocabulary) + ids[at]
        on = items.member[np.minimum(np.searchsorted(items.member, key), len(items.member) - 1)] == key
        yield slice(a, e), of[on], at[on]
        a = e


def _windows_of(row: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, items: Items, words_: np.ndarray) -> np.ndarray:
    """Distinct codes of (row, item, number of the window) for windows that hold a place from low to high; numbers count quarters of the item's length."""
    step = np.maximum(1, items.size[item] // 4)
    a, e = np.maximum(0, -(-(low - 2 * items.size[item] + 1) // step)), high // step
    last = np.maximum(0, -(-(words_[row] - 2 * items.size[item]) // step))  # a later window ends beyond the text and holds less
    a, e = np.minimum(a, last), np.minimum(e, last)
    n = e - a + 1
    row, item, k = np.repeat(row, n), np.repeat(item, n), places(a, n)
    return distinct((row * len(items.ids) + item) * (int(words_.max()) + 1) + k)


def _rare(row: np.ndarray, pos: np.ndarray, ids: np.ndarray, postings, items: Items) -> tuple[np.ndarray, ...]:
    """(row, item, first and last place) of stretches shorter than a window that have as many of an item's rarest words as a match needs."""
    start, owner, take = postings
    size = start[ids + 1] - start[ids]
    item = owner[places(start[ids], size)]
    row, pos = np.repeat(row, size), np.repeat(pos, size)
    order = np.lexsort((pos, item, row))
    row, item, pos = row[order], item[order], pos[order]
    at = np.arange(len(row))
    end = at + take[item] - 1
    on = end < len(row)
    at, end = at[on], end[on]
    on = (row[end] == row[at]) & (item[end] == item[at]) & (pos[end] - pos[at] < 2 * items.size[item[at]])
    at, end = at[on], end[on]
    return row[at], item[at], pos[at], pos[end]


def _found(batches, items: Items, scaled: np.ndarray, latent: np.ndarray, postings, s: Settings):
    """Matches of the batches of the compact table."""
    masks = [(_masks(x), _masks(y)) for x, y in zip(items.seqs, items.answers, strict=True)]
    for b in pieces(batches, 1 << 17, column="terms"):
        n, doc = ints(b, "n_words"), ints(b, "doc_id")
        ids = text_bytes(column(b, "ids"))[0].view(np.uint32).astype(np.int64)
        data, off = text_bytes(column(b, "places"))
        row, pos = np.repeat(np.arange(b.num_rows), np.diff(off) // 4), data.view(np.uint32).astype(np.int64)
        z, first, base = _latent(b, scaled, s)
        own = np.searchsorted(base, first, "right") - 1
        found = []
        for lo in range(0, len(latent), 1024):
            p, q = np.nonzero(z @ latent[lo : lo + 1024].T >= s.cosine)
            at = (first[p] - base[own[p]]) * s.half
            found.append((own[p], items.owner[lo + q], at, np.minimum(at + 2 * s.half, n[own[p]]) - 1))
        r, k, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        word = np.append(0, np.cumsum(n))  # first word of each row in the batch
        where = word[row] + pos
        lo, hi = np.searchsorted(where, np.maximum(word[r], word[r] + low - 2 * items.size[k])), np.searchsorted(where, np.minimum(word[r] + high + 2 * items.size[k], word[r + 1]))
        near = np.zeros(len(r), bool)
        for part, of, _ in _held(k, lo, hi, ids, items):
            near[part] = np.bincount(of - part.start, minlength=len(r[part])) >= items.least[k[part]]
        r, k, low, high = r[near], k[near], low[near], high[near]
        rare = _rare(row, pos, ids, postings, items)
        # windows around a passage: all that hold a place of it; around a stretch: all that hold the whole of it
        wide = _windows_of(r, k, low, high, items, n)
        tight = _windows_of(rare[0], rare[1], rare[3], rare[2], items, n)
        windows = distinct(np.concatenate([wide, tight]))
        if not len(windows):
            continue
        pair, w = np.divmod(windows, int(n.max()) + 1)
        r, k = np.divmod(pair, len(items.ids))
        begin = w * np.maximum(1, items.size[k] // 4)
        lo, hi = np.searchsorted(where, word[r] + begin), np.searchsorted(where, np.minimum(word[r] + begin + 2 * items.size[k], word[r + 1]))
        best: dict[tuple[int, int], tuple] = {}
        for part, of, at in _held(k, lo, hi, ids, items):  # an item's own words are all that its longest common subsequence looks at
            enough = np.flatnonzero(np.bincount(of - part.start, minlength=len(r[part])) >= items.least[k[part]]) + part.start
            cut = np.searchsorted(of, np.stack([enough, enough + 1]))
            for i, a, e in zip(enough.tolist(), *cut.tolist(), strict=True):
                seq, m = ids[at[a:e]].tolist(), int(items.size[k[i]])
                got = lcs_length(masks[k[i]][0], m, seq)
                answer = items.answers[k[i]]
                whole = bool(answer) and lcs_length(masks[k[i]][1], len(answer), seq) == len(answer)
                if got >= s.lcs * m - 1e-9 or (whole and got >= s.near * m - 1e-9):
                    pair = (int(r[i]), int(k[i]))
                    best[pair] = max(best.get(pair, (0.0, False, 0)), (got / m, whole, -int(begin[i])))
        if best:
            rows = []
            for (i, j), (ratio, whole, start) in sorted(best.items()):
                h = first[(own == i) & (first - base[i] >= -start // s.half - 1) & (first - base[i] <= (-start + 2 * items.size[j]) // s.half)]
                cos = z[np.searchsorted(first, h)] @ latent[items.owner == j].T
                rows.append((int(doc[i]), int(items.ids[j]), float(np.clip(cos.max(), -1, 1)), float(ratio), whole))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "cosine", "lcs_ratio", "answer"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, all columns, without the documents that contaminated() finds; rows with a null doc_id stay."""
    gone = saved(contaminated(docs, benchmark, settings).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
