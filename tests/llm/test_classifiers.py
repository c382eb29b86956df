"""Held-out accuracy and odd cases of the three classifiers."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inferframe.llm import language, quality, toxicity
from inferframe.llm.common import labelled_sample
from inferframe.llm.queries import llm_queries
from tests.llm.tables import crowded, documents

SF = "/root/testdata/sf0.01"


def held_out(spark, name, sf=SF):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return llm_queries()[name](spark, sf).where("held_out").join(labels, "doc_id")


def test_toxicity(spark):
    all_rows = llm_queries()["op2_toxicity"](spark, SF)
    assert all_rows.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    assert all_rows.where("(predicted = 1) <> (n_offending > 0)").count() == 0
    rows = held_out(spark, "op2_toxicity", "/root/testdata/sf0.1").where("toxic is not null").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) > 0.8


def test_quality(spark):
    rows = held_out(spark, "op3_quality").where("quality is not null").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = llm_queries()["op8_language_id"](spark, SF).join(docs, "doc_id").where("lang is not null and length(text) > 40").collect()
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_offending_sentences_are_located():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    texts, y = [], []
    for i in range(200):
        s = [" ".join(rng.choice(words, 6)) + "." for _ in range(5)]
        if i % 3 == 0:
            s[int(rng.integers(5))] = " ".join([*rng.choice(words, 3), "horrid", "fiend"]) + "."
        texts.append(" ".join(s)), y.append(float(i % 3 == 0))
    model = toxicity.train(texts, np.array(y))
    data = b"w1 w2 w3. w4 horrid fiend. w5 w6."
    start, _, s, g = toxicity._instances(np.frombuffer(data, np.uint8), np.array([0, len(data)]), model.weights)
    x = np.bincount(s, model.weights[g], len(start)) + model.bias
    assert x.argmax() == 1 and x[1] > 0 and max(x[0], x[2]) < 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    docs = documents(spark)
    kind = {toxicity: "toxic", quality: "quality"}[module]
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (8, 0), (3, 1), (None, 1), (4, None), (99, 1), (2, 0)], f"doc_id long, {kind} int")
    for ls in (labels, labels.where("false"), labels.where(f"{kind} = 1")):
        rows = module.score(crowded(docs), module.fit(docs, ls)).collect()
        assert len(rows) == docs.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 2}) == 1
    model = module.fit(docs, labels)
    assert module.score(docs.where("false"), model).collect() == []
    assert module.fit(docs.where("false"), labels) is not None


def test_language_of_odd_rows(spark):
    docs = documents(spark)
    model = language.fit(docs)
    rows = language.identify(crowded(docs), model).collect()
    assert len(rows) == docs.count()
    pred = {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] is not None}
    assert all(pred[i] == "und" for i in (3, 4, 5, 10, 11)) and pred[1] in ("en", "de", "fr")
    assert language.identify(docs.where("false"), model).collect() == []
    none = language.identify(docs, language.fit(docs.where("false"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and {r["score"] for r in none} == {0.0}
    one = language.identify(docs, language.fit(docs.where("lang = 'de'")))
    assert set(r["lang_pred"] for r in one.collect()) == {"de", "und"}


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_held_out_rows_of_quality_and_language_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert len(a.y) and np.array_equal(a.vectors, b.vectors) and np.array_equal(a.y, b.y)
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    c, d = language.fit(docs), language.fit(wrong)
    assert "xx" not in d.languages and np.array_equal(c.weights, d.weights)


def test_vote_by_brute_force():
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    v, w, y = unit(rng.normal(size=(70, 6))).astype(np.float32), unit(rng.normal(size=(40, 6))).astype(np.float32), rng.integers(0, 2, 40).astype(np.float32)
    got = quality.vote(v, quality.Model(None, None, w, y, 7, 0.5), block=16)
    for row, s in zip(v, got, strict=True):
        near = sorted(((float(row @ u), float(label)) for u, label in zip(w, y, strict=True)), reverse=True)[:7]
        weight = [max(c, 0) ** 8 for c, _ in near]
        assert abs(s - sum(a * b for a, (_, b) in zip(weight, near, strict=True)) / sum(weight)) < 1e-4


def test_terms_of_quality_by_brute_force():
    texts = ["The cat, the cat!! sat.", "", "a a a b a", "$$$ x$$$ --", "É é"]
    raw = [t.encode() for t in texts]
    got = quality.counts(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
    assert got[:, -quality.BACK :].tolist() == [[0, 2, 0, 0, 0, 0, 0, 0], [0] * 8, [2, 1, 0, 0, 0, 0, 0, 0], [0] * 8, [0] * 8]
    assert got[:, : quality.WORDS].sum(1).tolist() == [3, 0, 2, 1, 2] and got[:, quality.WORDS : -quality.BACK].sum(1).tolist() == [3, 0, 0, 3, 0]


def test_decoding_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = language.fit(docs)
    rows = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    for r in docs.collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            continue
        raw = r["text"].encode()
        f = language.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), window=97)[0] @ model.weights
        loss = [sum(np.log1p(np.exp(-f * word))) for word in model.code]
        got = rows[r["doc_id"]]
        assert got["lang_pred"] == model.languages[int(np.argmin(loss))]
        assert abs(got["score"] - np.exp(-min(loss)) / sum(np.exp(-np.array(loss)))) < 1e-3


def test_every_language_is_learned(spark):
    rows = [(i, f"{'abcdefghij'[i % 10] * 3} word{i % 10} text", f"l{i % 10}") for i in range(400)] + [(1000 + i, f"zz{i} rare qq", f"r{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {r["lang"] for r in docs.where("crc32(cast(doc_id as string)) % 4 <> 2").collect()}
    assert set(language.fit(docs, per_language=5, most=40).languages) == want


def test_no_letter_is_und(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅷ ①"), (2, "12 _ 3"), (3, "ª"), (4, "日"), (5, "٣"), (6, "a")], "doc_id long, text string")
    model = language.fit(spark.createDataFrame([(i, "some text", "en") for i in range(8)] + [(20 + i, "ein Satz", "de") for i in range(8)], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert [got[i] == "und" for i in range(1, 7)] == [True, True, False, False, True, False]


def test_noisy_or_by_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    some = docs.limit(40)
    rows = {r["doc_id"]: r for r in toxicity.score(some, model).collect()}
    for r in some.collect():
        raw, none = (r["text"] or "").encode().lower(), 1.0  # bytes.lower() treats A-Z only
        at, h = toxicity.grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for m in re.finditer(rb"[^\n!.?]*(?:[\n!.?]+|$)", raw):  # a gram belongs to the sentence in which it begins
            known = {x for i, x in zip(at.tolist(), h.tolist(), strict=True) if m.start() <= i < m.end() and model.weights[x]}
            if known:
                none *= 1 - 1 / (1 + np.exp(-(sum(float(model.weights[x]) for x in known) + model.bias)))
        assert abs(rows[r["doc_id"]]["score"] - (1 - none)) < 1e-6


@pytest.mark.parametrize("window", [1, 9, 50])
def test_sentences_in_windows(window):
    rng = np.random.default_rng(2)
    raw = ["".join(rng.choice(list("ab. !"), n)).encode() for n in (0, 3, 60, 0, 4, 5, 200)]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))
    weights = np.ones(1 << toxicity.BITS, np.float32)
    for got, want in zip(toxicity._instances(data, off, weights, window), toxicity._instances(data, off, weights), strict=True):
        assert np.array_equal(got, want)


def test_a_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(1, 21)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 21)], "doc_id long, toxic int")
    texts, y = labelled_sample(docs, labels, "toxic", {1: 50, 0: 50}, lambda i: i > 0, most_bytes=600)
    assert sum(map(len, texts)) <= 600 and 0 < y.sum() < len(y) and max(map(len, texts)) < 200


@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_codewords_differ(n):
    c = language.codewords(n)
    assert c.shape[0] == n and len({tuple(r) for r in c}) == n
