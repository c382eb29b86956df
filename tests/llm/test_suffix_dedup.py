import hashlib
import random

import numpy as np
import pytest

from inferframe.llm.queries import llm_oracle_sql, llm_queries
from inferframe.llm.suffix_dedup import _runs, copied, previous_factor, repeated_spans, runs
from tests.comparing import connect, differences
from tests.llm.tables import crowded, documents

SHAPE = "doc_id long, text string"


def brute(rows, n):
    """Per row what is left; rows of one doc_id are judged on their own, against smaller ids only."""
    out = []
    low = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for k in range(len(raw) - n + 1):
                low[raw[k : k + n]] = min(low.get(raw[k : k + n], i), i)
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        if i is not None:
            for k in range(len(raw) - n + 1):
                if low[raw[k : k + n]] < i:
                    gone[k : k + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in df.collect())


@pytest.mark.parametrize("hot", [4096, 1])
@pytest.mark.parametrize(("length", "k", "letters"), [(50, 24, "abcdefgh "), (50, 24, "ab"), (9, 4, "ab")])
def test_brute_force(spark, length, k, letters, hot):
    rng = random.Random(length + len(letters))
    parts = ["".join(rng.choices(letters, k=rng.randint(length // 2, 2 * length))) for _ in range(8)]
    rows = []
    for i in rng.sample(range(-50, 500), 40):
        rows.append((i, "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choices(letters + "é", k=rng.randint(0, length))) for _ in range(rng.randint(0, 6)))))
    for df in (spark.createDataFrame(rows, SHAPE), spark.createDataFrame(rows, SHAPE).repartition(9)):
        assert found(repeated_spans(df, length, k, hot)) == brute(rows, length)


def test_periodic_text(spark):
    rows = [(1, "ab" * 60), (2, "ab" * 100 + "x" + "ba" * 40), (3, "a" * 300), (4, "a" * 49), (5, "a" * 50), (6, "a" * 51 + "b")]
    assert found(repeated_spans(spark.createDataFrame(rows, SHAPE))) == brute(rows, 50)


def test_passage_in_very_many_documents(spark):
    """Each document has it between words of its own; its ends have as many different runs as there are documents."""
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=120))
    rows = [(i, f"{rng.random()} begins{i}" + passage[rng.randint(0, 9) :] + f"{rng.random()} ends{i}") for i in range(120)]
    for hot in (8, 4096):
        assert found(repeated_spans(spark.createDataFrame(rows, SHAPE).repartition(5), hot=hot)) == brute(rows, 50)


def test_odd_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(repeated_spans(crowded(docs))) == brute(rows, 50)
    assert repeated_spans(docs.where("false")).collect() == []


def test_rows_of_one_id_with_different_texts(spark):
    a, b = "x1" * 30 + "tail one", "head two " + "x1" * 30
    rows = [(2, a), (2, b), (3, a), (1, "y")]
    assert found(repeated_spans(spark.createDataFrame(rows, SHAPE))) == brute(rows, 50)


def test_spans_cut_what_is_removed(spark):
    docs = documents(spark).where("text is not null and doc_id is not null")
    for r in repeated_spans(docs).join(docs.dropDuplicates(["doc_id"]), "doc_id").collect():
        raw, at, kept = r["text"].encode(), 0, b""
        for s in r["spans"]:
            kept, at = kept + raw[at : s["start"]], s["end"]
        assert kept + raw[at:] == bytes(r["kept"]) and r["n_bytes"] - r["n_removed"] == len(r["kept"])


def test_longest_previous_factors():
    """Of suffixes in order, those whose longest match with a smaller document is a whole window are the copied ones."""
    rng = random.Random(2)
    texts = sorted("".join(rng.choices("ab", k=6)) for _ in range(60))
    doc = np.array([rng.randrange(9) for _ in texts])
    lcp = np.array([0] + [next((k for k in range(6) if a[k] != b[k]), 6) for a, b in zip(texts, texts[1:], strict=False)])
    want = [max([next((k for k in range(6) if t[k] != u[k]), 6) for u, e in zip(texts, doc, strict=True) if e < d], default=0) for t, d in zip(texts, doc, strict=True)]
    assert previous_factor(doc, lcp).tolist() == want
    words = [np.array([ord(t[k]) for t in texts], np.uint64) for k in range(6)]
    assert copied(doc, words, [1] * 6).tolist() == [w == 6 for w in want]
    shuffled = np.array([rng.randrange(9) for _ in range(400)])
    lcp = np.array([rng.randrange(4) for _ in shuffled])
    lcp[0] = 0
    for least in (1, 2):
        cut = np.where(lcp >= least, lcp, 0)
        best = [max([cut[min(i, j) + 1 : max(i, j) + 1].min() for j in range(400) if shuffled[j] < d], default=0) for i, d in enumerate(shuffled)]
        assert previous_factor(shuffled, lcp, least).tolist() == best


@pytest.mark.parametrize("window", [60, 97, 1 << 20])
def test_runs_of_long_texts_in_parts(window):
    """Each window of every text is in exactly one run, with the anchor that it has without parts."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab cd", k=n)).encode() for n in (0, 49, 50, 51, 400, 3, 120)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    want = {}
    for d, first, last, a, _ in zip(*_runs(data, off, 50, 24), strict=True):
        want.update({i: (d, a) for i in range(first, last + 1)})
    got = {}
    for d, first, last, a, _ in zip(*runs(data, off, 50, 24, window), strict=True):
        for i in range(first, last + 1):
            assert i not in got
            got[i] = (d, a)
    assert got == want


def test_text_of_twenty_megabytes(spark):
    passage = "a passage that two documents hold, far from the beginning of the longer one, over fifty bytes"
    rng = random.Random(1)
    unit = " ".join(f"w{rng.randrange(10**9)}" for _ in range(1000))
    text = "".join(f"{i}{unit}" for i in range(2))
    long = " ".join(str(i * 7919 % 10**9 + 10**8) for i in range(2_000_000))
    rows = [(1, passage + text), (2, long[: len(long) // 2] + passage + long[len(long) // 2 :])]
    got = {r["doc_id"]: r for r in repeated_spans(spark.createDataFrame(rows, SHAPE)).select("doc_id", "n_removed", "spans").collect()}
    at = len(long) // 2
    assert got[1]["n_removed"] == 0 and [(s["start"], s["end"]) for s in got[2]["spans"]] == [(at, at + len(passage))]


def test_query_equals_sql(spark, sf):
    name = "op10_suffix_array_dedup"
    assert differences(llm_queries()[name](spark, sf), llm_oracle_sql()[name], connect(sf)) == ""
    r = llm_queries()[name](spark, sf).where("n_removed = 0").first()
    assert len(r["kept_sha256"]) == len(hashlib.sha256().hexdigest())
