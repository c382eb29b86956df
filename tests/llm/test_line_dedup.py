import random
import re

import numpy as np
import pytest

from inferframe.llm.line_dedup import _units, repeated_units, units
from inferframe.llm.queries import llm_oracle_sql, llm_queries
from tests.comparing import connect, differences
from tests.llm.tables import SHARED, crowded, documents

SHAPE = "doc_id long, text string"


def norm(x):
    return re.sub(r"[\x09-\x0d\x20]+", " ", x.lower()).strip(" ").rstrip(".!? ")


def brute(rows, least=5):
    """Kept texts of rows with distinct ids."""
    seen, out = set(), {}

    def gone(x, words):
        if words < least:
            return False
        again = x in seen
        seen.add(x)
        return again

    for i, text in sorted(rows):
        lines = []
        for line in (text or "").split("\n"):
            parts = re.split(r"(?<=[.!?]) ", line)
            norms = [norm(p) for p in parts]
            full = [k for k, x in enumerate(norms) if x]
            n = [len(x.split(" ")) if x else 0 for x in norms]
            whole = len(full) > 1 and gone(" ".join(norms[k] for k in full), sum(n))
            drop = {k for k in full if gone(norms[k], n[k])}
            for a, k, b in zip(full, full[1:], full[2:], strict=False):
                if n[k] < least and gone((norms[a], norms[k], norms[b]), n[a] + n[k] + n[b]):
                    drop.add(k)
            stay = [p for k, p in enumerate(parts) if k not in drop]
            if not whole and stay:
                lines.append(" ".join(stay))
        out[i] = "\n".join(lines)
    return out


def test_brute_force(spark):
    rng = random.Random(4)
    sentences = [" ".join(rng.choices(["a", "bb", "Ccc", "dd", "É", "e!", "f?"], k=rng.randint(1, 8))) + rng.choice(["", ".", "!?", " ..", "  "]) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice([". ", ".  ", " ", "! ", "?! "]).join(rng.choices(sentences, k=rng.randint(0, 4))) for _ in range(rng.randint(0, 5)))) for i in rng.sample(range(1000), 80)]
    got = {r["doc_id"]: r for r in repeated_units(spark.createDataFrame(rows, SHAPE)).collect()}
    want = brute(rows)
    assert {i: r["kept"] for i, r in got.items()} == want
    assert all(r["n_removed"] == len(r["text"].encode()) - len(want[i].encode()) for i, r in got.items())
    for r in got.values():
        for s in r["spans"]:
            assert norm(r["text"].encode()[s["start"] : s["end"]].decode())


def test_passage_inside_a_line(spark):
    passage = "it began as a quiet day. Nobody in the village had seen the river so low before. They walked out on the stones and"
    rows = [(1, "First text tells that " + passage + " sang."), (2, "Another one says that " + passage + " wept. The end.")]
    got = {r["doc_id"]: r for r in repeated_units(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["kept"] == "Another one says that it began as a quiet day. They walked out on the stones and wept. The end."
    s = got[2]["spans"][0]
    assert rows[1][1].encode()[s["start"] : s["end"]] == b"Nobody in the village had seen the river so low before."


def test_short_sentences_between_repeated_ones_go(spark):
    passage = "Nobody in the village had seen it so low! Not once. They all walked out on the wet stones? Yes. The old bridge was dry for a week."
    rows = [(1, "One begins. " + passage + " One ends."), (2, "Two begins. " + passage + " Two ends."), (3, "Not once. Yes.")]
    got = {r["doc_id"]: r for r in repeated_units(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got[2]["kept"] == "Two begins. Two ends." and got[3]["n_removed"] == 0 == got[1]["n_removed"] and len(got[2]["spans"]) == 5


def test_odd_rows(spark):
    docs = documents(spark)
    got = repeated_units(crowded(docs)).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_removed"] for r in by[1]] == [0] or by[-5]
    assert all(r["kept"] == (r["text"] or "") and r["n_removed"] == 0 for r in by[None])  # no rank: whole, and no source
    assert by[3][0]["kept"] == "" and by[4][0]["kept"] == "" and by[5][0]["kept"] == "   \n\t "
    assert by[2][0]["kept"] == by[2][1]["kept"]
    assert by[-5][0]["kept"] == SHARED.upper() and SHARED not in by[9][0]["kept"]
    assert repeated_units(docs.where("false")).collect() == []


@pytest.mark.parametrize("n", [1, 3])
def test_minimum_of_words(spark, n):
    rows = [(1, "a b c\nx"), (2, "A  b c.\nx")]
    got = {r["doc_id"]: r["kept"] for r in repeated_units(spark.createDataFrame(rows, SHAPE), n).collect()}
    assert got == brute(rows, n)


@pytest.mark.parametrize("window", [1, 7, 60])
def test_units_of_long_texts_in_windows(window):
    rng = random.Random(window)
    raw = ["".join(rng.choices(["aa ", "b ", ". ", "! ", "\n", "\n\n", "cc"], k=n)).encode() for n in (0, 40, 3, 0, 200, 1, 90)]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))
    want = sorted(zip(*(x.tolist() for x in _units(data, off, 3)), strict=True))
    assert sorted(zip(*(x.tolist() for x in units(data, off, 3, window)), strict=True)) == want and len(want) > 10


def test_query_equals_sql(spark, sf):
    name = "op7_line_dedup"
    assert differences(llm_queries()[name](spark, sf), llm_oracle_sql()[name], connect(sf)) == ""
