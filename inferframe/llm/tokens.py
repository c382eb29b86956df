"""Token ids in directly addressable codes: chunk levels with continuation bitmaps and rank directories."""

from __future__ import annotations

import os
import struct
import sys
import types
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, documents, ints, pieces, places, shuffles_go, text_bytes, trimmed
from .shingles import _windows, mix

MAGIC = b"DAC1"
BLOCK = 512  # bits of a bitmap for each entry of its rank directory


def encode(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A segment: header, offsets of its documents, and per level the bytes, the continuation bitmap and the ranks at each block."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.append(bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8))
        rank = np.cumsum(np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32), dtype=np.uint32)
        rank = np.append(np.uint32(0), rank[:-1]).astype("<u4") if len(rank) else rank.astype("<u4")
        levels.append((rest.astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out = [MAGIC, struct.pack("<QII", len(ids), len(lengths), len(levels)), np.append(0, np.cumsum(lengths)).astype("<u8").tobytes()]
    for parts in levels:
        out += [struct.pack("<QQQ", *map(len, parts)), *parts]
    return b"".join(out)


@dataclass(frozen=True)
class Segment:
    n: int
    offsets: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def read(blob: bytes) -> Segment:
        if blob[:4] != MAGIC:
            raise ValueError("not a token segment")
        n, docs, count = struct.unpack_from("<QII", blob, 4)
        offsets, at, levels = np.frombuffer(blob, "<u8", docs + 1, 20).astype(np.int64), 20 + 8 * (docs + 1), []
        for _ in range(count):
            a, b, c = struct.unpack_from("<QQQ", blob, at)
            at += 24
            levels.append((np.frombuffer(blob, np.uint8, a, at), np.frombuffer(blob, np.uint8, b, at + a), np.frombuffer(blob, "<u4", c // 4, at + a + b)))
            at += a + b + c
        return Segment(n, offsets, levels)

    def token(self, i: int) -> int:
        """The id at position i: one byte, one bit and one rank at each level, nothing else is decoded."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            part = bits[block * BLOCK // 8 : (i >> 3) + 1].copy()
            part[-1] &= (1 << (i & 7)) - 1
            i = int(rank[block]) + int(np.bitwise_count(part).sum())
        return value

    def tokens(self) -> np.ndarray:
        """All ids, by merging the levels from the last."""
        out = None
        for chunks, bits, _ in reversed(self.levels):
            ids = chunks.astype(np.uint32)
            if out is not None:
                ids[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(8)
            out = ids
        return out


#: White space beside the space and the newline, as UTF-8 (fixed values).
ODD = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
WIDE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


#: ASCII letters, and ASCII marks but for the apostrophe, with which a piece of letters may begin.
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
BLANK = np.zeros(256, bool)
BLANK[32] = True
MARK[[c for c in b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~']] = True


class Known:
    """Token ids of chunks seen before, in arrays: an open-addressing table from a chunk's key to its place.

    A chunk is told by its length, its first and its last eight bytes, and a hash of what lies between.
    """

    def __init__(self, most: int):
        self.most = most
        self.slots = 1 << max(10, (2 * most - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.table = np.full(self.slots, -1, np.int32)
        self.keys, self.head, self.end = (np.zeros(self.most, np.uint64) for _ in range(3))
        self.at, self.count = np.zeros(self.most + 1, np.int64), np.zeros(self.most, np.int32)
        self.ids, self.n = np.zeros(4 * self.most, np.uint32), 0

    def find(self, key: np.ndarray, head: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of chunks; -1 for those that aren't known."""
        out, left, slot = np.full(len(key), -1, np.int32), np.arange(len(key)), (key & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            got = self.table[slot]
            place = np.maximum(got, 0)
            same = (got >= 0) & (self.keys[place] == key[left]) & (self.head[place] == head[left]) & (self.end[place] == end[left])
            out[left[same]] = got[same]
            on = (got >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def add(self, key: np.ndarray, head: np.ndarray, end: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Distinct chunks that aren't known yet, with their ids one after another; there must be room."""
        a, b = self.n, self.n + len(key)
        self.keys[a:b], self.head[a:b], self.end[a:b], self.count[a:b] = key, head, end, count
        self.at[a + 1 : b + 1] = self.at[a] + np.cumsum(count)
        while self.at[b] > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids), np.uint32))
        self.ids[self.at[a] : self.at[b]] = ids
        left, slot = np.arange(a, b), (key & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of several for one slot the last stays
            on = self.table[slot] != left
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        self.n = b


class Encoder:
    """The tokenizers library behind a bounded memory of word-like chunks.

    Byte-level BPE splits a text before it merges: always before a single space or around a single newline that stands between two
    other characters, and between a letter and a mark that isn't an apostrophe. Cut there, a chunk has the same ids alone as in its text. Chunks not seen lately are encoded
    by the library, many in one call, and told apart by the bytes of their tokens. Texts with a special token's string, with runs of white space
    or with white space that the cut doesn't treat go to the library whole. Either way a long text goes in windows, which end before a
    single space (between two letters for the library), so that only its ids take memory beside it.
    """

    def __init__(self, path: str, most: int = 1 << 19, window: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tok, self.known, self.window = Tokenizer.from_file(path), Known(most), window
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # each character of a token stands for a byte
            self.size[i] = len(token)

    @staticmethod
    def cached(path: str) -> Encoder:
        """One for each worker process, kept from task to task."""
        kept = sys.modules.setdefault("_inferframe_encoders", types.ModuleType("_inferframe_encoders")).__dict__
        if path not in kept:
            kept[path] = Encoder(path)
        return kept[path]

    def _whole(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts that the cut doesn't treat."""
        white = (data == 32) | (data == 10)
        bad = np.zeros(len(data), bool)
        bad[:-1] = white[:-1] & white[1:]
        for c in ODD:
            bad |= data == c
        raw = data.tobytes()
        for c in (*(w for w in WIDE if w in raw), *(w for w in self.special if w in raw)):
            at = raw.find(c)
            while at >= 0:
                bad[at] = True
                at = raw.find(c, at + 1)
        out = np.zeros(len(off) - 1, bool)
        out[np.searchsorted(off, np.flatnonzero(bad), "right") - 1] = True
        some = np.flatnonzero(np.diff(off))
        out[some] |= white[off[some]] | white[off[some + 1] - 1]
        return out

    def _learn(self, data: np.ndarray, key, head, end, start, length) -> None:
        spaced = data[start] == 32
        # a chunk that doesn't begin with a space stands behind a newline, which is a chunk of its own, or is one
        lone = (length == 1) & (data[start] == 10)
        group = np.flatnonzero(~lone)
        sizes = length + np.where(spaced, 0, 1)
        ids, count = [], np.zeros(len(key), np.int64)
        for lo in range(0, len(group), 4096):
            g = group[lo : lo + 4096]
            n = sizes[g]
            text = np.full(n.sum(), 10, np.uint8)
            begin = np.cumsum(n) - n + np.where(spaced[g], 0, 1)
            text[places(begin, length[g])] = data[places(start[g], length[g])]
            got = np.array(self.tok.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.int64)
            last = np.cumsum(self.size[got])
            cut = np.searchsorted(last, begin + length[g]) + 1
            first = np.searchsorted(last, begin, "right")
            count[g] = cut - first
            ids.append(got[places(first, count[g])].astype(np.uint32))
        if lone.any():
            newline = np.array(self.tok.encode("\n", add_special_tokens=False).ids, np.uint32)
            order, count[lone] = np.append(group, np.flatnonzero(lone)), len(newline)
            ids += [newline] * int(lone.sum())
        else:
            order = group
        self.known.add(key[order], head[order], end[order], count[order], np.concatenate(ids))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of each text's); texts are UTF-8 bytes from off to off."""
        n = len(off) - 1
        whole, total, found = self._whole(data, off), np.zeros(n, np.int64), [np.zeros(0, np.uint32)]
        for lo, hi in _windows(data, off, BLANK, self.window):
            edges = off[np.searchsorted(off, lo, "right") : np.searchsorted(off, hi)]
            first = int(np.searchsorted(off, lo, "right")) - 1  # the text that holds the window's first byte
            texts = np.concatenate([[lo], edges, [hi]]) - lo
            own = np.searchsorted(off, texts[:-1] + lo, "right") - 1
            ids, count = self._chunks(data[lo:hi], texts, whole[own])
            found.append(ids)
            total[first : first + 1 + int(own[-1]) - first] += np.bincount(own - first, count, int(own[-1]) - first + 1).astype(np.int64)
        ids = np.concatenate(found)
        if not whole.any():
            return ids, total
        where = np.flatnonzero(whole)
        at, parts, last = np.append(0, np.cumsum(total)), [], 0
        for i in where:
            own = self._library(data[off[i] : off[i + 1]])
            parts += [ids[at[last] : at[i]], own]
            total[i], last = len(own), i
        return np.concatenate([*parts, ids[at[last] :]]), total

    def _chunks(self, data: np.ndarray, off: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a window, but for those to skip, by their chunks, and the number of each."""
        begin, newline = np.zeros(len(data), bool), data == 10
        begin |= newline | (data == 32)
        begin[1:] |= newline[:-1] | (LETTER[data[:-1]] & MARK[data[1:]])
        begin[off[:-1][off[:-1] < off[1:]]] = True
        start = np.flatnonzero(begin)
        doc = np.searchsorted(off, start, "right") - 1
        length = np.diff(np.append(start, len(data)))
        if skip.any():
            on = ~skip[doc]
            start, doc, length = start[on], doc[on], length[on]
        key, head, end = _chunk_keys(data, start, length)
        place = self.known.find(key, head, end)
        new = np.flatnonzero(place < 0)
        if len(new):
            one = new[_first_of(key[new], head[new], end[new])]
            if self.known.n + len(one) > self.known.most:
                self.known.clear()
                new = np.arange(len(key))
                one = _first_of(key, head, end)
                if len(one) > self.known.most:  # more chunks than fit: the library takes the texts
                    got = [np.zeros(0, np.uint32) if s else self._library(data[a:b]) for a, b, s in zip(off[:-1], off[1:], skip, strict=True)]
                    return np.concatenate(got), np.array([len(x) for x in got], np.int64)
            self._learn(data, key[one], head[one], end[one], start[one], length[one])
            place[new] = self.known.find(key[new], head[new], end[new])
        size = self.known.count[place].astype(np.int64)
        return self.known.ids[places(self.known.at[place], size)], np.bincount(doc, size, len(off) - 1).astype(np.int64)

    def _library(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text from the library, in windows that end before a space between two ASCII letters."""
        parts, lo, n = [np.zeros(0, np.uint32)], 0, len(data)
        while lo < n:
            hi = lo + self.window
            while hi < n:
                x = data[hi - 1 : hi + self.window + 1]
                some = np.flatnonzero((x[1:-1] == 32) & LETTER[x[:-2]] & LETTER[x[2:]]) if len(x) > 2 else np.zeros(0, int)
                if len(some):
                    hi += int(some[0])
                    break
                hi += self.window
            parts.append(np.array(self.tok.encode(data[lo : min(hi, n)].tobytes().decode(), add_special_tokens=False).ids, np.uint32))
            lo = min(hi, n)
        return np.concatenate(parts)


def _chunk_keys(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first eight bytes, last eight bytes) of chunks. Up to 16 bytes these and the length, which is in the key, tell a chunk exactly."""
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))  # the eight bytes from each position
    short = np.minimum(length, 8).astype(np.uint64) * np.uint64(8)
    mask = np.where(length >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(short, np.uint64(63))) - np.uint64(1))
    head = eight[start + 8] & mask
    end = np.where(length > 8, eight[np.maximum(start + length, 0)], np.uint64(0))
    key = mix(head * np.uint64(0x9E3779B97F4A7C15) + mix(end + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    at, left = 8, np.flatnonzero(length > 16)
    while len(left):
        key[left] = mix(key[left] * np.uint64(0xD6E8FEB86659FD93) + eight[start[left] + 8 + at])
        at += 8
        left = left[length[left] > at + 8]
    return key, head, end


def _first_of(*cols: np.ndarray) -> np.ndarray:
    """Places of the first row of each distinct combination."""
    order = np.lexsort(cols)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order[new]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, segment_ids: int = 1 << 20, in_order: bool = True) -> None:
    """Encode every whole text and write the segments, in ascending doc_id order, as rows of binary under path/segments.

    Texts are dealt by ranges of doc_id and text; a task writes segments of about segment_ids ids (a longer document is one segment) with
    the number of ids before them in the task. Without in_order rows are written in the order in which docs has them, so that
    a shuffled table stays shuffled. A row of path/segments: part, seq, before long, doc_ids array<long>, blob. The
    only global figures are the totals of the tasks, under path/totals. A null text is empty; null doc_ids come first; repeated
    doc_ids are ordered by a hash of the text (identical rows stay in one task, which streams them). An empty table writes no segment.
    """
    rows = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def write(batches):
        from pyspark import TaskContext

        part, seq, before, enc = TaskContext.get().partitionId(), 0, 0, Encoder.cached(tokenizer)
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        size = 0

        def segment():
            lengths = np.concatenate([x[1] for x in held])
            blob = encode(np.concatenate([x[0] for x in held]), lengths)
            names = [i for x in held for i in x[2]]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["part", "seq", "before", "n_tokens", "doc_ids", "blob"])

        for b in pieces(batches):
            ids, n = enc.encode(*text_bytes(column(b, "text")))
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), np.uint32(end_id)), n + 1
            names, at, i = column(b, "doc_id").to_pylist(), np.append(0, np.cumsum(n)), 0
            while i < len(names):
                # whole documents until the segment is full; the first one always fits
                j = int(np.searchsorted(at, at[i] + segment_ids - size, "right")) - 1
                j = min(max(j, i + (not held)), len(names))
                if j > i:
                    held.append((ids[at[i] : at[j]], n[i:j], names[i:j]))
                    size, i = size + int(at[j] - at[i]), j
                if i < len(names):
                    yield segment()
                    seq, before, size, held = seq + 1, before + size, 0, []
        if held:
            yield segment()

    if in_order:
        tie = F.xxhash64("text")
        rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    out = rows.mapInArrow(trimmed(write), "part int, seq int, before long, n_tokens long, doc_ids array<long>, blob binary")
    with shuffles_go(docs.sparkSession):
        out.write.parquet(f"{path}/segments")
    docs.sparkSession.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n")).write.parquet(f"{path}/totals")


#: Writing tasks (16 bytes each) up to which their starts are broadcast.
BROADCAST_TASKS = 500_000


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with the number of ids before them; the running sum goes over one row for each writing task."""
    totals = spark.read.parquet(f"{path}/totals")
    base = totals.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    if totals.count() <= BROADCAST_TASKS:
        base = F.broadcast(base)
    return spark.read.parquet(f"{path}/segments").join(base, F.col("part") == F.col("p")).withColumn("start", (F.col("base") + F.col("before")).cast("long"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) and, if asked for, ids array<int>."""

    def read(batches):
        for b in batches:
            for start, names, blob in zip(ints(b, "start"), column(b, "doc_ids").to_pylist(), column(b, "blob"), strict=True):
                seg = Segment.read(blob.as_py())
                ids, off = seg.tokens().astype("<u4"), seg.offsets
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)]
                cols = [pa.array(names, pa.int64()), pa.array(off[:-1] + start), pa.array(np.diff(off)), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return _segments(spark, path).select("start", "doc_ids", "blob").mapInArrow(trimmed(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at a position of the whole output: the segment is found by narrow columns, and it alone is read, by a filter that reaches the scan."""
    row = _segments(spark, path).where((F.col("start") <= position) & (F.col("start") + F.col("n_tokens") > position)).select("part", "seq", "start").first()
    if row is None:
        raise IndexError(position)
    blob = spark.read.parquet(f"{path}/segments").where((F.col("part") == row["part"]) & (F.col("seq") == row["seq"])).select("blob").first()["blob"]
    return Segment.read(bytes(blob)).token(position - row["start"])
