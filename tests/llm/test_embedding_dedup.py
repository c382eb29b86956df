import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inferframe.llm.embedding_dedup import embedding_components
from inferframe.llm.queries import llm_oracle_sql, llm_queries
from tests.comparing import connect, differences
from tests.llm.tables import crowded, sorted_rows

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    def sound(r):
        x = r[1]
        return r[0] is not None and r[2] is not None and x is not None and len(x) and all(c is not None and math.isfinite(c) for c in x) and any(x)

    links = {}
    good = [r for r in rows if sound(r)]
    for i, p in enumerate(good):
        for j, q in enumerate(good):
            if i != j and p[2] == q[2] and len(p[1]) == len(q[1]):
                x, y = np.float64(np.float32(p[1])), np.float64(np.float32(q[1]))
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                    links.setdefault(i, []).append(j)
    out, root = [], list(range(len(good)))
    for _ in good:
        for i, js in links.items():
            root[i] = min([root[i], *(root[j] for j in js)], key=lambda k: good[k][0])
    out = [(r[0], len(links.get(i, [])), good[root[i]][0], r[0] == good[root[i]][0]) for i, r in enumerate(good)]
    return sorted((tuple(map(str, r)) for r in out + [(r[0], 0, r[0], None if r[0] is None else True) for r in rows if not sound(r)]))


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        c = centres[rng.integers(12)] + rng.normal(scale=0.1, size=dim)
        rows.append((i * 7 % n, [float(v) for v in np.float32(c)], int(rng.integers(2))))
    return rows + [(n + i, rows[i][1], rows[i][2]) for i in range(5)]


@pytest.mark.parametrize(("cell", "pivots"), [(1000, 4096), (20, 4096), (7, 4)])
def test_brute_force(spark, cell, pivots):
    rows = clustered(240, 8, 1)
    df = spark.createDataFrame(rows, SHAPE)
    for numbers in (1 << 19, 150):  # one block for a cell, and blocks of some 19 vectors
        assert sorted_rows(embedding_components(df, cell_rows=cell, max_pivots=pivots, block_numbers=numbers)) == brute(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [1.0, float("nan"), 3.0], 0), (10, [float("inf"), 2.0, 3.0], 0), (None, v, 0), (11, [2.0, 4.0, 6.0], 0), (12, [1.0, 2.0], 0), (13, [-1.0, -2.0, -3.0], 0), (-4, [1e-30, 2e-30, 3e-30], 0), (14, [1e30, 2e30, 3e30], 0)]
    df = spark.createDataFrame(rows, SHAPE)
    got = sorted_rows(embedding_components(crowded(df)))
    assert got == brute(rows)
    assert sorted_rows(embedding_components(df.repartition(7))) == got
    assert embedding_components(df.where("false")).collect() == []


def test_one_id_with_two_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.02], 0)], SHAPE)
    assert sorted_rows(embedding_components(df)) == [("1", "0", "1", "True"), ("1", "2", "1", "True"), ("2", "2", "1", "False"), ("3", "2", "1", "False")]


def test_labels_can_be_ignored(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 1)], SHAPE)
    assert {r["component_id"] for r in embedding_components(df, same_label=False).collect()} == {1}


def test_chain_is_one_component(spark):
    step = math.acos(0.9801)
    rows = [(100 - i, [math.cos(step * i), math.sin(step * i)], 0) for i in range(30)]
    df = spark.createDataFrame(rows, SHAPE)
    got = embedding_components(df, cell_rows=5).collect()
    assert {r["component_id"] for r in got} == {71} and {r["n_links"] for r in got} == {1, 2}


def test_query_equals_sql(spark, sf):
    name = "op1_embedding_near_dedup"
    assert differences(llm_queries()[name](spark, sf), llm_oracle_sql()[name], connect(sf)) == ""
    assert llm_queries()[name](spark, sf).where(F.col("vec_id").isNull()).count() == 0
