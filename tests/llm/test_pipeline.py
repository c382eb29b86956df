"""The corpus pipeline, each stage against its own input."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from inferframe.llm import decontaminate
from inferframe.llm.minhash_dedup import Settings, near_duplicates
from tests.llm.tables import crowded, documents
from tests.llm.test_minhash_dedup import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = (before, docs)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == COLUMNS
    # quality: labelled good documents stay, bad ones go
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    a, b = ({r["doc_id"] for r in x.collect()} for x in kept["quality classifier"])
    good, bad = [i for i in a if labels.get(i) == 1], [i for i in a if labels.get(i) == 0]
    assert np.mean([i in b for i in good]) > 0.95 and (not bad or np.mean([i in b for i in bad]) < 0.3)
    # near-duplicates: one of each group stays, by brute force over all pairs
    before, after = kept["minhash near-dedup"]
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in before.collect()}
    low = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    assert {r["doc_id"] for r in after.collect()} == {i for i in sets if low[i] == i}
    # decontamination: no document that holds an item word for word stays, the others mostly do
    before, after = kept["benchmark decontamination"]
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in before.collect() if any(t in " ".join((r["text"] or "").split()) for t in items)}
    stay = {r["doc_id"] for r in after.collect()}
    assert not held & stay and len(stay) > 0.9 * (before.count() - len(held))
    # mixing: copies of whole rows only
    before, after = kept["mixing"]
    rows = {tuple(r) for r in before.collect()}
    assert all(tuple(r) in rows for r in after.collect())
    # tokens: every copy is written
    before, after = kept["token output"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], zlib.crc32(np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in before.collect())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in after.collect()) == want
    assert cp.run(spark, sf).count() == after.count()


def test_stages_on_odd_rows(spark, sf):
    docs = documents(spark).select(*COLUMNS)
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).count()
        assert stage(spark, docs.where("false"), sf).collect() == [], name
    assert set(cp.near_dedup(spark, crowded(docs), sf).columns) == set(crowded(docs).columns)


def test_stages_pass_on_clashing_columns_and_rows_without_an_id(spark, sf):
    docs = crowded(documents(spark).select(*COLUMNS))
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert {r["rid"] for r in got.collect()} <= {"clash"}
        if name in ("minhash near-dedup", "benchmark decontamination"):
            assert got.where("doc_id is null").count() == 2, name
    assert cp.tokens(spark, docs, sf).count() == docs.count()


def test_quality_judges_each_row_by_its_text(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["text"] for r in cp.quality_filter(spark, docs, sf).collect()}
    good, bad = next(t for i, t in texts.items() if labels.get(i) == 1 and t in kept), next(t for i, t in texts.items() if labels.get(i) == 0 and t not in kept)
    rows = [(-7, good), (-7, bad), (None, good), (None, bad), (-8, good), (-8, good)]
    got = cp.quality_filter(spark, docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text")), sf)
    n = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert n[None, good] == 1 and n[None, bad] == 0 and n[-7, bad] == 0 and n[-8, good] >= 2


def test_tokens_keep_the_mixed_order(spark, sf):
    docs = cp.mix(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).coalesce(1)
    want = [r["doc_id"] for r in docs.collect()]
    got = [r["doc_id"] for r in cp.tokens(spark, docs, sf).orderBy("start").collect()]
    assert got == want and want != sorted(want)


def test_near_dedup_keeps_rows_without_words(spark, sf):
    docs = documents(spark).select(*COLUMNS)
    left = {r["doc_id"] for r in cp.near_dedup(spark, docs, sf).collect()}
    low = {r["doc_id"]: r["kept"] for r in near_duplicates(docs, Settings(words=5)).collect()}
    assert {3, 4, 5} <= left and {i for i, k in low.items() if k} == {i for i in left if i is not None}


def test_near_dedup_keeps_rows_without_an_id(spark, sf):
    rows = [(None, "a text without an id"), (None, None), (3, "one text that two documents hold"), (5, "one text that two documents hold"), (5, "another text that one alone holds"), (7, "one text that two documents hold")]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert Counter(r["doc_id"] for r in got) == {None: 2, 3: 1, 5: 2}  # an id stays if one of its texts does


def test_decontamination_fits_its_vectors_on_every_passage(spark, sf, monkeypatch):
    """120,000 passages of a word each."""
    docs, fit, seen = spark.range(120_000).selectExpr("id AS doc_id", "concat('w', id % 50) AS text"), decontaminate._fit, []

    def spied(texts, *rest):
        seen.append(texts.selectExpr("sum(length(terms)) / 2").first()[0])
        return fit(texts, *rest)

    monkeypatch.setattr(decontaminate, "_fit", spied)
    assert cp.decontaminate(spark, docs, sf).count() == 120_000 and seen == [120_000]
