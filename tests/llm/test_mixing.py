import hashlib
import math
import random
from collections import Counter

import pytest

from inferframe.llm.mixing import mix_sources
from inferframe.llm.queries import llm_oracle_sql, llm_queries
from tests.comparing import connect, differences
from tests.llm.tables import crowded, documents, sorted_rows


def corpus(spark, sizes):
    return spark.createDataFrame([(i, f"t{i}", s) for s, (a, b) in sizes.items() for i in range(a, b)], "doc_id long, text string, source string")


def test_sources_meet_their_weights(spark):
    docs = corpus(spark, {"a": (0, 3000), "b": (3000, 3600)})
    rows = mix_sources(docs, {"a": 1, "b": 3}).collect()
    n = Counter(r["source"] for r in rows)
    assert abs(n["a"] - 900) < 5 * math.sqrt(900) and abs(n["b"] - 2700) < 5 * math.sqrt(2700)
    per = Counter(r["doc_id"] for r in rows if r["source"] == "b")
    k = Counter(per.get(i, 0) for i in range(3000, 3600))
    for c in range(3, 7):  # Poisson of mean 4.5
        p = math.exp(-4.5) * 4.5**c / math.factorial(c)
        assert abs(k[c] - 600 * p) < 5 * math.sqrt(600 * p)
    assert all(sorted(r["copy_no"] for r in rows if r["doc_id"] == i) == list(range(1, c + 1)) for i, c in list(per.items())[:20])


def test_does_not_depend_on_partitions(spark):
    docs = corpus(spark, {"a": (0, 300), "b": (300, 330)})
    assert sorted_rows(mix_sources(docs)) == sorted_rows(mix_sources(docs.repartition(7)))
    assert sorted_rows(mix_sources(docs)) != sorted_rows(mix_sources(docs, seed="other"))


def test_order_is_global(spark):
    keys = [r["shuffle_key"] for r in mix_sources(corpus(spark, {"a": (0, 500)})).orderBy("shuffle_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_large_rates(spark):
    docs = corpus(spark, {"a": (0, 3000), "b": (3000, 3002)})
    n = Counter(r["source"] for r in mix_sources(docs, {"b": 1.0}).collect())
    assert n["a"] == 0 and abs(n["b"] - 3002) < 5 * math.sqrt(3002)


def test_the_plan_does_not_grow_with_the_rate(spark):
    """Rates of about 1, 15, 250 and 2,000,000: counts lie around them."""
    rng = random.Random(3)
    sizes = {"a": 1, "b": 300, "c": 5000}
    docs = spark.createDataFrame([(rng.randrange(10**9), "t", s) for s in sizes for _ in range(20)], "doc_id long, text string, source string")
    got = mix_sources(docs, {s: float(n) for s, n in sizes.items()}, rounds=sum(sizes.values()) / 60).groupBy("source", "doc_id", "n_copies", "rate").count().collect()
    for s, n in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert own and all(abs(r["n_copies"] - r["rate"]) < 6 * math.sqrt(r["rate"]) + 4 for r in own)
    two = spark.createDataFrame([(1, "t", "a")], "doc_id long, text string, source string")
    assert abs(mix_sources(two, rounds=2_000_000.0).count() - 2_000_000) < 6 * math.sqrt(2_000_000)


@pytest.mark.parametrize("rate", [0.3, 7.0, 399.0, 401.0, 5000.0])
def test_counts_invert_the_distribution(spark, rate):
    docs = spark.createDataFrame([(i, "a") for i in range(40)], "doc_id long, source string")
    got = {r["doc_id"]: r["n"] for r in mix_sources(docs, rounds=rate).groupBy("doc_id").agg({"*": "count"}).toDF("doc_id", "n").collect()}
    for i in range(40):
        u, k, p = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        if rate < 700:
            total = p
            while total <= u:
                k, p = k + 1, p * rate / (k + 1)
                total += p
            assert got.get(i, 0) == k
        else:
            assert abs(got[i] - rate) < 6 * math.sqrt(rate)


def test_odd_rows(spark):
    docs = documents(spark)
    rows = mix_sources(crowded(docs), rounds=20.0)
    assert set(rows.columns) >= set(crowded(docs).columns) and rows.where("source is null").count() > 0 and rows.where("text is null").count() > 0
    per = Counter(r["doc_id"] for r in rows.where("doc_id = 2").collect())
    assert per[2] % 2 == 0  # both of the repeated rows draw the same count
    assert mix_sources(docs.where("false")).collect() == []
    clash = docs.withColumnsRenamed({"n_chars": "copy_no"})
    assert mix_sources(clash).columns.count("copy_no") == 1


@pytest.mark.parametrize("name", ["op5_mixing"])
def test_query_equals_sql(spark, sf, name):
    assert differences(llm_queries()[name](spark, sf), llm_oracle_sql()[name], connect(sf)) == ""
