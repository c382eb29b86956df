import random
import re

import numpy as np
import pyarrow as pa

from inferframe.llm import decontaminate
from inferframe.llm.decontaminate import Settings, _masks, answer_words, contaminated, decontaminated, lcs_length
from tests.llm.tables import crowded, documents

D, B = "doc_id long, text string", "item_id long, text string"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}x" for _ in range(n)]


def case(seed=1, items=12, docs=60):
    """Items, and documents of which some hold an item verbatim, some with words changed, most none."""
    rng = random.Random(seed)
    bench = [(i, " ".join(words(rng, rng.randint(12, 60)))) for i in range(items)]
    rows, want = [], set()
    for d in range(docs):
        text = words(rng, rng.randint(0, 300))
        if d % 3 == 0:
            i = rng.randrange(items)
            held = bench[i][1].split()
            if d % 2:
                for _ in range(max(1, len(held) // 10)):
                    held[rng.randrange(len(held))] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in held]
            want.add((d, i))
        rows.append((d, " ".join(text)))
    return rows, bench, want


def tokens(text):
    return [w for w in re.split(r"[ \t\n\x0b\x0c\r!-/:-@\[-`{-~]+", (text or "").lower()) if w]


def brute(rows, bench, s=Settings()):
    """Matches by the definition: every window of every document against every item."""
    out = set()
    for d, text in rows:
        doc = tokens(text)
        for i, item in bench:
            t, answer = tokens(item), tokens(answer_words(item or ""))
            m = len(t)
            for start in range(0, len(doc), max(1, m // 4)) if m else ():
                window = doc[start : start + 2 * m]
                if len(set(t) & set(window)) * 2 < s.near * len(set(t)):
                    continue
                n = lcs(t, window)
                if n >= s.lcs * m - 1e-9 or (n >= s.near * m - 1e-9 and answer and lcs(answer, window) == len(answer)):
                    out.add((d, i))
    return out


def test_equals_brute_force(spark):
    rows, bench, want = case()
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(spark.createDataFrame(rows, D), spark.createDataFrame(bench, B)).collect()}
    assert got == brute(rows, bench) == want


def test_short_items_and_common_words_equal_brute_force(spark):
    """Items of 1 to 30 words, of a small vocabulary, so that matches by chance are frequent."""
    rng = random.Random(8)
    pool = [f"c{i}" for i in range(40)]
    bench = [(i, " ".join(rng.choices(pool, k=n)) + rng.choice(["", "? " + rng.choice(pool)])) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 10, 15, 30])]
    rows = [(d, " ".join(rng.choices(pool, k=rng.choice([0, 1, 5, 40, 130])))) for d in range(60)]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(spark.createDataFrame(rows, D), spark.createDataFrame(bench, B)).collect()}
    want = brute(rows, bench)
    assert got == want and len(want) > 20


def paraphrase(words, rng):
    """A tenth of the words changed, a tenth gone, some put in between."""
    out = []
    for w in words:
        x = rng.random()
        if x < 0.08:
            out.append("changed")
        elif x >= 0.16:
            out.append(w)
        if rng.random() < 0.08:
            out.append("put")
    return out


def test_paraphrases_in_the_tables_equal_brute_force(spark, sf):
    """Every item, paraphrased inside a document; and all that the documents hold by themselves."""
    rng = random.Random(2)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    rows = [(r["doc_id"], (r["text"] or "")[:3000]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    planted = set()
    for d, (i, text) in enumerate(bench):
        host = rows[d % len(rows)][1].split()
        at = rng.randint(0, len(host))
        rows.append((10_000 + d, " ".join(host[:at] + paraphrase(text.split(), rng) + host[at:])))
        planted.add((10_000 + d, i))
    found = contaminated(spark.createDataFrame(rows, D), spark.createDataFrame(bench, B)).collect()
    got, want = {(r["doc_id"], r["item_id"]) for r in found}, brute(rows, bench)
    assert got == want and len(want & planted) >= 0.9 * len(planted)
    assert all(-1 <= r["cosine"] <= 1 and 0.6 <= r["lcs_ratio"] <= 1 for r in found)


def test_latent_search_ranks_the_item(spark, sf):
    """The latent cosine of a passage that holds an item's text is far above that of others: recall of the first tenth of passages, by brute force."""
    s = Settings()
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").limit(150)
    table = compact_of(spark, docs)
    idf, n = decontaminate._frequencies(table, s)
    scaled = (decontaminate._fit(decontaminate._sample(table, s, n), idf, s) * idf[:, None]).astype(np.float32)
    b = pa.Table.from_batches(pa.RecordBatch.from_pylist([r.asDict()], schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("terms", pa.binary())])) for r in table.collect()).combine_chunks().to_batches()[0]
    z, first, base = decontaminate._latent(b, scaled, s)
    terms, at = decontaminate._terms(b), np.append(0, np.cumsum(b.column(1).to_numpy()))
    rng, ranks = random.Random(1), []
    for _ in range(60):
        d = rng.randrange(b.num_rows)
        if at[d + 1] - at[d] < 120:
            continue
        x = at[d] + 32 * rng.randrange((at[d + 1] - at[d]) // 32 - 2)
        query = scaled[terms[x : x + 40]].sum(0)
        cos = z @ (query / np.linalg.norm(query))
        own = np.flatnonzero(first == base[d] + (x - at[d]) // 32)[0]
        ranks.append((cos > cos[own]).mean())
    assert len(ranks) > 20 and np.mean(np.array(ranks) < 0.1) >= 0.9


def compact_of(spark, docs):
    rows = [(r["doc_id"], decontaminate._hashes(r["text"])) for r in docs.collect()]
    rows = [(i, len(h), (h >> np.uint64(64 - decontaminate.BITS)).astype(np.uint16).tobytes()) for i, h in rows if len(h)]
    return spark.createDataFrame(rows, "doc_id long, n_words long, terms binary")


def test_singular_vectors(spark):
    """The fitted vectors span what numpy's SVD of the whole matrix gives."""
    rng = np.random.default_rng(3)
    topics = rng.integers(0, decontaminate.TERMS, (4, 30))
    rows = [(rng.choice(topics[i % 4], 64).astype(np.uint16).tobytes(),) for i in range(400)]
    s, idf = Settings(rank=4, skip=0), np.ones(decontaminate.TERMS)
    got = decontaminate._fit(spark.createDataFrame(rows, "terms binary").repartition(3), idf, s)
    a = np.zeros((400, decontaminate.TERMS))
    for i, (t,) in enumerate(rows):
        np.add.at(a[i], np.frombuffer(t, np.uint16), 1)
    _, _, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(np.abs(np.linalg.svd(vt[:4] @ got)[1]), 1, atol=1e-3)


def test_singular_vectors_are_those_of_all_passages(spark):
    """400,000 passages of a word and the next one: vectors of a fourth of them, picked at random, are off by over 0.001."""
    rng = np.random.default_rng(4)
    pool = rng.choice(decontaminate.TERMS, 40, replace=False).astype(np.uint16)
    share = 0.7 ** np.arange(40)
    texts = [rng.choice(pool, 2000, p=share / share.sum()) for _ in range(200)]
    table = spark.createDataFrame([(i, len(t), t.tobytes()) for i, t in enumerate(texts)], "doc_id long, n_words long, terms binary").repartition(3)
    s, idf = Settings(half=1, rank=4, skip=0), np.ones(decontaminate.TERMS)
    n = decontaminate._frequencies(table, s)[1]
    got = decontaminate._fit(decontaminate._sample(table, s, n), idf, s)
    a = np.concatenate([(x[:-1, None] == pool) * 1.0 + (x[1:, None] == pool) for x in texts])
    v = np.linalg.eigh(a.T @ a)[1][:, -4:]
    assert n == 400_000 and np.linalg.norm(got[pool] - v @ (v.T @ got[pool])) < 2e-4


def test_sums_by_runs():
    rng = np.random.default_rng(5)
    for run in (2, 3, 32):
        x, size = rng.standard_normal((50, 7)), rng.integers(1, 200, 300)
        rows = rng.integers(0, 50, size.sum())
        assert np.allclose(decontaminate._sums(x, rows, size, run, 16), np.add.reduceat(x[rows], np.cumsum(size) - size, axis=0))


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 20))] for _ in "ab")
        assert lcs_length(_masks(a), len(a), b) == lcs(a, b)


def test_answers():
    assert answer_words("What is it? A fox.").strip() == "A fox."
    assert answer_words("Question. Answer: forty two").strip() == "forty two"
    assert answer_words("First part. The end.").strip() == "The end."


def test_odd_rows(spark):
    docs = documents(spark)
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while seven wise owls"), (2, None), (3, ""), (None, "the quick brown"), (4, "..."), (4, "one"), (1, "w1 w4 w9 w16 w25 w36 w49 w64 w81 w100 w121")], B)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(crowded(docs), crowded(bench)).collect()}
    assert {(1, 1), (2, 1), (9, 1), (-5, 1), (7, 1), (8, 1)} <= got and {i for _, i in got} <= {1, 4} and None not in {d for d, _ in got}
    assert contaminated(docs.where("false"), bench).collect() == [] and contaminated(docs, bench.where("false")).collect() == []
    left = decontaminated(crowded(docs), bench)
    assert left.columns == crowded(docs).columns and left.where("doc_id is null").count() == 2
    assert {r["doc_id"] for r in left.collect()}.isdisjoint({d for d, _ in got})


def test_verbatim_items_are_found_in_the_tables(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    texts = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in docs.collect()}
    want = {(d, r["item_id"]) for r in bench.collect() for d, t in texts.items() if " ".join(r["text"].split()) in t}
    assert want and want <= got


def test_verbatim_items_of_common_words_inside_ordinary_text(spark):
    """Every word of the items is in far over 5% of the passages, next to words of other items that are rare."""
    rng = random.Random(6)
    common, rest = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(1500)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.5 else rng.choice(rest) for _ in range(n)]

    bench = [(i, " ".join(rng.sample(common, n))) for i, n in enumerate([9, 12, 20, 20, 30, 30, 40, 47])]
    bench += [(100 + i, " ".join(rng.sample(rest, 40))) for i in range(37)]
    bench.append((50, " ".join(rng.sample(common, 5))))
    rows, want = [], set()
    for d in range(240):
        text = prose(rng.randint(150, 400))
        i, held = bench[d % 8]
        if d < 160:
            held = held.split()
            if d >= 80:  # some words changed
                for k in range(0, len(held), 7):
                    held[k] = "changed"
            want.add((d, i))
            at = rng.randint(0, len(text))
            text[at:at] = held
        rows.append((d, " ".join(text)))
    rows.append((999, " ".join([*prose(90), bench[-1][1], *prose(90)])))
    want.add((999, 50))
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(spark.createDataFrame(rows, D), spark.createDataFrame(bench, B)).collect()}
    assert want <= got == brute(rows, bench)
