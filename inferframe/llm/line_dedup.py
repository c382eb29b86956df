"""Substring dedup by line hashing: the earliest ranked occurrence of a line, or of a sentence in a line, stays, later ones go."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, documents, ints, pieces, saved, text_bytes, trimmed
from .shingles import SPACE, _windows, mix, words

#: Marks that end a sentence; they don't count at the end of a unit.
END = np.zeros(256, bool)
END[[33, 46, 63]] = True
SENTENCE = re.compile(rb"(?<=[.!?]) ")
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: A unit's place in its text: line * 2^31 + sentence + 1; sentence -1 is the whole line.
LINE = 1 << 31


def _digests(h: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of word hashes that begins at cut."""
    size = np.diff(np.append(cut, len(h)))
    at = np.arange(len(h)) - np.repeat(cut, size)
    out = []
    for x, p in ((h, A), (mix(h ^ B), B)):
        power = np.full(int(size.max()), p, np.uint64)
        power[0] = 1
        out.append(mix(np.add.reduceat(x * np.cumprod(power)[at], cut) + size.astype(np.uint64)))
    return out[0], out[1]


NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def units(data: np.ndarray, off: np.ndarray, min_words: int, window: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_units() of texts, a very long one in windows of whole lines."""
    if len(data) <= 2 * window:
        return _units(data, off, min_words)
    found, last, lines, at = [], -1, 0, 0
    for lo, hi in _windows(data, off, NEWLINE, window):
        inner = off[np.searchsorted(off, lo, "right") : np.searchsorted(off, hi)]
        texts = np.concatenate([[lo], inner, [hi]])
        own = np.searchsorted(off, texts[:-1], "right") - 1
        # lines of the window's first text that lie before it
        lines = (lines if own[0] == last else 0) + int(np.count_nonzero(data[max(at, int(off[own[0]])) : lo] == 10))
        last, at = own[0], lo
        doc, place, h1, h2 = _units(data[lo:hi], texts - lo, min_words)
        found.append((own[doc], place + np.where(doc == 0, lines * LINE, 0), h1, h2))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _units(data: np.ndarray, off: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, two hashes) of the units of lower-cased texts that have min_words words.

    Lines end at newlines, sentences also behind a mark (. ! ?) before a space. A unit's normal form is its words, without the marks that end it; that
    of a line is the words of its sentences, and a line counts as a unit of its own if two of its sentences have words. A sentence of fewer words
    is a unit together with the sentences before and behind it in its line (those that have words), if the three have min_words; its place is its own.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if not len(data):
        return none
    data = data.copy()
    text = np.zeros(len(data), bool)
    text[off[:-1][off[:-1] < off[1:]]] = True
    newline, dot = data == 10, np.zeros(len(data), bool)
    dot[:-1] = END[data[:-1]] & (data[1:] == 32) & ~text[1:]
    # blank the marks before each end
    first = text.copy()
    first[1:] |= newline[:-1]
    first[2:] |= dot[:-2]
    begin = np.flatnonzero(first)
    end = np.concatenate([np.flatnonzero(newline | dot), off[1:]])
    low = begin[np.maximum(np.searchsorted(begin, end) - 1, 0)]  # of an empty unit, that of the one before, which loses its marks anyway
    data[dot] = 32
    while len(end):
        on = end > low
        end, low = end[on] - 1, low[on]
        mark = END[data[end]]
        data[end[mark]] = 32
        on = mark | SPACE[data[end]]
        end, low = end[on], low[on]
    start, _, h, _ = words(data, off)
    if not len(start):
        return none
    line_of, unit_of = np.cumsum(text | np.append(False, newline[:-1])), np.cumsum(first)
    lines, own = line_of[start], unit_of[start]
    doc = np.searchsorted(off, start, "right") - 1
    starts = np.flatnonzero(text | np.append(False, newline[:-1]))
    dots = np.cumsum(dot)
    base = np.concatenate([[0], dots])[starts[lines - 1]]
    sentence = dots[start] - base - dot[start]
    number = lines - line_of[off[doc]]
    cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    of_line = np.flatnonzero(np.append(True, lines[1:] != lines[:-1]))
    several = np.diff(np.append(np.searchsorted(cut, of_line), len(cut))) > 1
    found = []
    for at, place, on in ((cut, number[cut] * LINE + sentence[cut] + 1, None), (of_line, number[of_line] * LINE, several)):
        keep = np.diff(np.append(at, len(start))) >= min_words
        if on is not None:
            keep &= on
        h1, h2 = _digests(h, at)
        found.append((doc[at][keep], place[keep], h1[keep], h2[keep]))
        if on is None:
            size, line = np.diff(np.append(at, len(start))), lines[at]
            mid = np.flatnonzero((size[1:-1] < min_words) & (line[1:-1] == line[:-2]) & (line[1:-1] == line[2:]) & (size[1:-1] + size[:-2] + size[2:] >= min_words)) + 1
            three = [mix(mix(mix(x[mid - 1] ^ A) * B + x[mid]) * A + x[mid + 1]) for x in (h1, h2)]
            found.append((doc[at][mid], place[mid], *three))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def without(raw: bytes, gone: set[int]) -> tuple[bytes, list[dict]]:
    """A text without the units at these places, and their spans; a line of which nothing stays goes with its newline, a sentence with the space before it."""
    kept, spans, at = [], [], 0
    for n, line in enumerate(raw.split(b"\n")):
        if n * LINE in gone:
            spans.append({"start": at, "end": at + len(line)})
        else:
            parts, stay, x = SENTENCE.split(line), [], at
            for k, part in enumerate(parts):
                if n * LINE + k + 1 in gone:
                    spans.append({"start": x, "end": x + len(part)})
                else:
                    stay.append(part)
                x += len(part) + 1
            if stay:
                kept.append(b" ".join(stay))
        at += len(line) + 1
    return b"\n".join(kept), spans


def repeated_units(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """Drop lines, and sentences within lines, that occurred before, in rank order (doc_id, line, sentence; a line ranks before its sentences).

    Units are lines; a line of several sentences also has each sentence as a unit, as shared passages often stand inside a line, and a short
    sentence goes where it stands between the same two sentences as before. A
    unit is normalised (lower case, white space and the marks at its end don't count) and hashed to 128 bits; units of fewer than
    min_words words are never dropped by themselves. Digests are counted globally, with partial counts before the shuffle; only units whose digest repeats
    are ranked, again by a pre-aggregated minimum, over joins that Spark may split where one unit is in very many documents.

    Returns, per row, doc_id, text, n_bytes, n_removed (bytes by which the text shrinks), spans array<struct<start long, end
    long>> (removed units, offsets in the original UTF-8 bytes) and kept (what stays: lines joined by newlines, sentences by spaces). A null or empty text
    has no units. Repeated rows (same doc_id and text) share their ranks, so none of them loses the copy that is kept; rows with the same
    doc_id and different texts are ranked by a hash. A null doc_id has no rank: its row stays whole and is no source. An empty table gives
    an empty result. Other columns are ignored.
    """
    rows = documents(docs)
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))

    def found(batches):
        for b in pieces(batches):
            ids, rids = ints(b, "doc_id"), ints(b, "rid")
            doc, place, h1, h2 = units(*text_bytes(pc.utf8_lower(column(b, "text"))), min_words)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[doc], rids[doc], place, h1.view(np.int64), h2.view(np.int64))], ["doc_id", "rid", "place", "h1", "h2"])

    ranked = rows.where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    every = saved(ranked.mapInArrow(trimmed(found), "doc_id long, rid long, place long, h1 long, h2 long"), "units")
    again = saved(every.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2")), "again")
    twice = saved(every.join(again, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).drop("g1", "g2"), "twice")
    discard(every)
    first = saved(twice.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "rid", "place")).alias("first")).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first.*").toDF("g1", "g2", "f_doc", "f_rid", "f_place"), "first")
    later = twice.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where((F.col("doc_id") != F.col("f_doc")) | (F.col("rid") != F.col("f_rid")) | (F.col("place") != F.col("f_place")))
    gone = saved(later.select("rid", "place").distinct().groupBy("rid").agg(F.collect_list("place").alias("gone")).withColumnRenamed("rid", "r"), "gone")  # a text's own units
    discard(again, twice, first)

    def rebuild(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in pieces(batches):
            data, off = text_bytes(column(b, "text"))
            spans, kept = [], []
            for i, drop in enumerate(column(b, "gone").to_pylist()):
                raw, cut = data[off[i] : off[i + 1]].tobytes(), []
                if drop:
                    raw, cut = without(raw, set(drop))
                spans.append(cut), kept.append(raw)
            before, size = np.diff(off), np.array([len(x) for x in kept], np.int64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "text"), pa.array(before), pa.array(before - size), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "text", "n_bytes", "n_removed", "spans", "kept"])

    return rows.join(gone, F.col("rid") == F.col("r"), "left").select("doc_id", "text", "gone").mapInArrow(trimmed(rebuild), "doc_id long, text string, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept string")
