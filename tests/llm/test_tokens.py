import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inferframe.llm.queries import llm_queries
from inferframe.llm.tokens import Encoder, Segment, encode, read_tokens, token_at, write_tokens
from tests.llm.tables import crowded, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = [" ", "  ", "\n", "\n\n", "\t", "a", "word", "Don't", "'s", "'", "’", "é", "É,", "12", "3,4", "x.y", "(", "--", "…", "<|endoftext|>", "<|", "日本", "　", "\xa0", " ", "🙂", "A" * 40, "internationalisation", "?!", " .", ".com", "'ll", "\r\n", "\x1c", "²", "ñ."]


def ids_of(texts, enc):
    raw = [t.encode() for t in texts]
    ids, n = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw], dtype=np.int64)))
    off = np.append(0, np.cumsum(n))
    return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=5)), max_size=25).map("".join), max_size=12), st.sampled_from([20, 100_000]))
def test_same_ids_as_the_library(texts, most):
    texts = [t for t in texts if t.isprintable() or t.encode("utf-8", "ignore").decode() == t]
    assert ids_of(texts, Encoder(PATH, most)) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES + ["big bird sang", " a b c "]), max_size=40).map("".join), max_size=5), st.integers(1, 40))
def test_same_ids_in_windows(texts, window):
    assert ids_of(texts, Encoder(PATH, 5000, window)) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=700), max_size=6))
def test_codes_round_trip(docs):
    ids, lengths = np.array([i for d in docs for i in d], np.uint32), np.array([len(d) for d in docs], np.int64)
    seg = Segment.read(encode(ids, lengths))
    assert seg.tokens().tolist() == ids.tolist() and np.diff(seg.offsets).tolist() == lengths.tolist()
    for i in {0, len(ids) // 2, len(ids) - 1, 511, 512, 513} & set(range(len(ids))):
        assert seg.token(i) == ids[i]
    with pytest.raises(IndexError):
        seg.token(len(ids))


def test_random_access_over_blocks():
    ids = np.random.default_rng(1).choice(np.array([3, 200, 300, 70_000, 2**24, 2**31], np.uint32), 5000)
    seg = Segment.read(encode(ids, np.array([5000])))
    assert [seg.token(i) for i in range(5000)] == ids.tolist()
    with pytest.raises(ValueError):
        Segment.read(b"nope" + bytes(40))


def expected(rows, end=2):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + ([end] if end is not None else [])
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize(("segment", "end"), [(1 << 20, 2), (50, 2), (1, None)])
def test_files(spark, tmp_path, segment, end):
    docs = documents(spark)
    path = str(tmp_path / "t")
    write_tokens(crowded(docs), path, PATH, end, segment)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in read_tokens(spark, path).orderBy("start", "n_tokens").collect()]
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()], end)
    assert got == want if end is not None else sorted(map(str, got)) == sorted(map(str, want))
    flat = [i for w in want for i in w[4]]
    for k in (0, 1, len(flat) // 2, len(flat) - 1):
        assert token_at(spark, path, k) == flat[k]
    with pytest.raises(IndexError):
        token_at(spark, path, len(flat))


def test_rows_in_their_own_order(spark, tmp_path):
    """Without in_order a shuffled table, with copies of documents, stays as it is."""
    rows = [(i * 7 % 50, f"text number {i * 7 % 50}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    write_tokens(docs, str(tmp_path / "t"), PATH, in_order=False)
    got = read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in rows] and got[-1]["start"] + got[-1]["n_tokens"] == sum(r["n_tokens"] for r in got)


def test_one_token_reads_one_segment(spark, tmp_path):
    write_tokens(spark.range(100).selectExpr("id doc_id", "concat('text ', id) text"), str(tmp_path / "t"), PATH, segment_ids=20)
    plan = spark.read.parquet(str(tmp_path / "t/segments")).where("part = 1 and seq = 2").select("blob")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(part,1)" in plan and "EqualTo(seq,2)" in plan


def test_very_long_text(spark, tmp_path):
    """A text of 20 MB beside a short one, in windows."""
    text = " ".join(f"word{i % 9973}" for i in range(2_200_000))
    write_tokens(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), str(tmp_path / "t"), PATH)
    got = {r["doc_id"]: r for r in read_tokens(spark, str(tmp_path / "t"), with_ids=False).collect()}
    want = LIBRARY.encode(text[:40_000], add_special_tokens=False).ids
    assert got[2]["start"] == got[1]["n_tokens"] and [token_at(spark, str(tmp_path / "t"), k) for k in (0, 1, 9000)] == [want[0], want[1], want[9000]]


def test_empty_table(spark, tmp_path):
    write_tokens(documents(spark).where("false"), str(tmp_path / "t"), PATH)
    assert read_tokens(spark, str(tmp_path / "t")).collect() == []


def test_query(spark, sf):
    got = [tuple(r) for r in llm_queries()["op6_token_output"](spark, sf).orderBy("doc_id").collect()]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == [w[:4] for w in expected(rows)]
