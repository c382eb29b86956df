import random
import re

import pytest

from inferframe.llm import common
from inferframe.llm.minhash_dedup import Settings, fewest_matches, near_duplicates
from inferframe.llm.queries import llm_oracle_sql, llm_queries
from tests.comparing import connect, differences
from tests.llm.tables import crowded, documents, sorted_rows

SHAPE = "doc_id long, text string"


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n=2):
    sets = [shingles(t, n) for _, t in rows]
    low = {i: i for i, _ in rows if i is not None}
    links = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return sorted(tuple(map(str, (i, len(s), low.get(i), None if i is None else low[i] == i))) for (i, _), s in zip(rows, sets, strict=True))


def variants(seed, n=60):
    rng, rows = random.Random(seed), []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, max(1, len(words) // 7))):
                words[rng.randrange(len(words))] = f"v{rng.randrange(50)}"
        else:
            words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 60))]
        rows.append((rng.randrange(10**6), " ".join(words)))
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize("n", [2, 5])
def test_brute_force(spark, n):
    rows = variants(n)
    assert sorted_rows(near_duplicates(spark.createDataFrame(rows, SHAPE), Settings(words=n))) == brute(rows, n)


def test_large_groups(spark):
    """Buckets above the limit for signature comparison, groups above one block, and exact copies."""
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(80)], []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(80)] = f"v{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5000 + i, rows[0][1]) for i in range(40)]
    assert sorted_rows(near_duplicates(spark.createDataFrame(rows, SHAPE), Settings(words=2, block=8))) == brute(rows)


def test_odd_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted_rows(near_duplicates(crowded(docs), Settings(words=2)))
    assert got == brute(rows)
    assert near_duplicates(docs.where("false")).collect() == []


def test_threshold_is_inclusive(spark):
    a = [f"w{i}" for i in range(10)]
    rows = [(1, " ".join(a[:9])), (2, " ".join(a[:10] + ["x"])), (3, "p q"), (4, "p  Q")]
    assert sorted_rows(near_duplicates(spark.createDataFrame(rows, SHAPE), Settings(words=2))) == brute(rows)


def test_bounds_prune_only_the_improbable():
    for n, fewest in fewest_matches(150, 16, 80, 1e-7):
        assert 0 <= fewest < 0.8 * n


def test_recall_of_planted_pairs_near_the_threshold(spark):
    """1,000 pairs of similarity 0.80 to 0.82 among 2,000 documents: all are linked."""
    rng, rows, want = random.Random(12), [], 0
    for i in range(1000):
        a = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        b = list(a)
        for k in rng.sample(range(0, 200, 10), rng.choice([9, 10])):  # each change takes five shingles of each side at most
            b[k] = f"x{rng.randrange(10**6)}"
        s, t = shingles(" ".join(a), 2), shingles(" ".join(b), 2)
        for _ in range(20):
            if len(s & t) / len(s | t) <= 0.82:
                break
            b[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
            t = shingles(" ".join(b), 2)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        want += 0.8 <= len(s & t) / len(s | t) <= 0.82
    got = near_duplicates(spark.createDataFrame(rows, SHAPE), Settings(words=2)).where("not kept and component_id = doc_id - 1").count()
    linked = sum(100 * len(a & b) >= 80 * len(a | b) for a, b in ((shingles(rows[i][1], 2), shingles(rows[i + 1][1], 2)) for i in range(0, 2000, 2)))
    assert want > 300 and got == linked


@pytest.mark.parametrize("n", [60, 400])
def test_components_by_star_rounds(spark, monkeypatch, n):
    """Beyond the bound for one task: the rounds on the cluster give what union-find gives."""
    monkeypatch.setattr(common, "ONE_TASK_EDGES", 0)
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n * 2 // 3)] + [(1000 + i, 1001 + i) for i in range(12)] + [(-5, 2000 + i) for i in range(30)]
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == c for x, c in low.items())


def test_text_of_twenty_megabytes(spark):
    text = " ".join(f"w{i * 7919 % 10**7}" for i in range(2_300_000))
    rows = [(1, text), (2, text + " end"), (3, "short")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, SHAPE).repartition(3)).collect()}
    n = len({tuple(x) for x in zip(*[text.split()[k:] for k in range(5)], strict=False)})
    assert got == {1: (n, 1), 2: (n + 1, 1), 3: (1, 3)}


def test_query_equals_sql(spark, sf):
    name = "op9_minhash_near_dedup"
    assert differences(llm_queries()[name](spark, sf), llm_oracle_sql()[name], connect(sf)) == ""
