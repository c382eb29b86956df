"""Suffix-array dedup: bytes covered by a string that an earlier document has, by longest-previous-factor arrays.

Sorting every suffix of the corpus would shuffle each byte dozens of times. Instead every 50-byte window is represented by
its anchor, the smallest k-gram hash inside it, so equal windows have equal anchors. Windows with the same anchor in a row
form a run. (1) Runs are grouped by digest: a run that an earlier document holds in full is a copy. A digest is the 64-bit hash of the anchor's
gram and that of the run's first window, last window (which cover all its bytes) and length. (2) Of the rest, only runs
whose anchor several documents share can hold a copied window; their bytes are grouped by anchor, the suffixes are sorted, and their
longest-previous-factor array, by previous and next smaller positions in suffix order, tells which windows an earlier document has. Texts travel
twice, runs as 17 bytes each, and bytes only where a repeat begins or ends.

A passage that very many documents hold doesn't gather in one task: a task sends a run once, for its smallest document, and settles its
other documents itself; and an anchor with very many different runs is dealt by windows instead, again once for a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, distinct, documents, in_groups, ints, pieces, places, saved, text_bytes, trimmed
from .shingles import BYTE, POWER, mix

#: Bytes of text for each bucket and shard.
SHARE = 4 << 20


#: Bytes that are hashed at a time; the arrays take some 100 bytes for each.
WINDOW = 1 << 20


def gram_hashes(data: np.ndarray, sizes: tuple[int, ...], window: int = WINDOW) -> list[np.ndarray]:
    """For each size, the hash of the size bytes from every position that has as many."""
    if len(data) <= 2 * window:
        return _gram_hashes(data, sizes)
    out = [[] for _ in sizes]
    for lo in range(0, len(data), window):
        part = _gram_hashes(data[lo : lo + window + max(sizes) - 1], sizes)
        for own, h in zip(out, part, strict=True):
            own.append(h[:window])
    return [np.concatenate(h) for h in out]


def _gram_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """By doubling."""
    n, out = len(data), []
    power, h = {1: POWER}, {1: BYTE[data]}
    step = 1
    while step * 2 <= max(sizes):
        power[2 * step] = np.uint64(int(power[step]) ** 2 & 0xFFFFFFFFFFFFFFFF)
        h[2 * step] = h[step][: max(0, n - 2 * step + 1)] * power[step] + h[step][step : step + max(0, n - 2 * step + 1)]
        step *= 2
    for size in sizes:
        m, at, acc = max(0, n - size + 1), 0, None
        for bit in sorted((p for p in h if size & p), reverse=True):
            part = h[bit][at : at + m]
            acc = part.copy() if acc is None else acc * power[bit] + part
            at += bit
        out.append(mix(acc))
    return out


def runs(data: np.ndarray, off: np.ndarray, length: int, k: int, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: (text, first window, last window, anchor hash, run hash); windows never cross texts.

    A very long text goes in parts; a run that is cut there has other hashes than the whole one, so that its windows are compared one by one.
    """
    found = []
    for lo in range(0, max(1, len(data)), window):
        part = data[lo : lo + window + length - 1]
        inner = off[np.searchsorted(off, lo, "right") : np.searchsorted(off, lo + len(part))] - lo
        _, first, last, a, w = _runs(part, np.concatenate([[0], inner, [len(part)]]), length, k)
        first, last = first + lo, last + lo
        found.append((np.searchsorted(off, first, "right") - 1, first, last, a, w))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    n, width = len(data), length - k + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if n < length:
        return none
    hk, hl = gram_hashes(data, (k, length))
    v = ((hk >> np.uint64(32)) << np.uint64(32)) | np.arange(len(hk), dtype=np.uint64)  # the leftmost of equal hashes wins
    low, span = v, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: -(width - span)], low[width - span :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    own = np.diff(off)
    fits = np.zeros(n + 1, np.int32)
    ok = own >= length
    np.add.at(fits, off[:-1][ok], 1)
    np.add.at(fits, off[1:][ok] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(fits)[: len(anchor)])
    if not len(s):
        return none
    a = anchor[s]
    cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)))
    first, last, q = s[cut], s[np.append(cut[1:], len(s)) - 1], a[cut]
    whole = mix(hl[first] * np.uint64(0x9E3779B97F4A7C15) + hl[last] + (last - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.searchsorted(off, first, "right") - 1, first, last, hk[q], whole


def _smaller_before(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix, what it has in common with the suffix at the previous position in order whose document is smaller; 0 without one.

    All positions follow their links at once: that of the position before, if its document isn't smaller, leads to its own, and so on.
    """
    n = len(doc)
    at, common = np.arange(n) - 1, lcp.copy()
    common[:1] = 0
    at[common == 0] = -1  # nothing in common with any before
    done = (at < 0) | (doc[at] < doc)
    while len(todo := np.flatnonzero(~done & done[at])):
        to = at[todo]
        common[todo] = np.minimum(common[todo], common[to])
        at[todo] = np.where(common[todo] == 0, -1, at[to])
        common[todo[at[todo] < 0]] = 0
        done[todo] = (at[todo] < 0) | (doc[at[todo]] < doc[todo])
    return common


def previous_factor(doc: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest-previous-factor array in suffix order: for each suffix the longest prefix that a suffix of a smaller document has; 0 if that is under least.

    lcp[i] is what suffixes i - 1 and i have in common. The best match stands at the previous or the next position in suffix
    order that holds a smaller document, with the smallest lcp in between.
    """
    lcp = np.where(lcp >= least, lcp, 0)
    lcp[:1] = 0
    after = np.append(0, lcp[1:][::-1]) if len(lcp) else lcp
    return np.maximum(_smaller_before(doc, lcp), _smaller_before(doc[::-1], after)[::-1])


def _in_common(words: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """Bytes at the start that neighbours in a sorted list of suffixes have in common, given as big-endian words of so many bytes."""
    n = len(words[0])
    out, same = np.zeros(n, np.int64), np.append(False, np.ones(max(0, n - 1), bool))[:n]
    for w, size in zip(words, sizes, strict=True):
        x = np.zeros(n, np.uint64)
        x[1:] = w[1:] ^ w[:-1]
        equal = np.zeros(n, np.int64)
        for k in range(1, size + 1):
            equal += (x >> np.uint64(8 * (size - k))) == 0
        out += np.where(same, equal, 0)
        same &= x == 0
    return out


def copied(doc: np.ndarray, words: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """Suffixes of one length, given as big-endian words: whether the longest previous factor of each is the whole of it."""
    order = np.lexsort((doc, *reversed(words)))
    lcp = _in_common([w[order] for w in words], sizes)
    out = np.zeros(len(order), bool)
    out[order] = previous_factor(doc[order], lcp, sum(sizes)) >= sum(sizes)
    return out


def _key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + y)


def _has(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known) or not len(x):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _same(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Whether the length bytes from x and from y are the same."""
    out, step = np.ones(len(x), bool), np.arange(length)
    for lo in range(0, len(x), 20_000):
        out[lo : lo + 20_000] = (data[x[lo : lo + 20_000, None] + step] == data[y[lo : lo + 20_000, None] + step]).all(1)
    return out


def _deal(part: np.ndarray, make) -> list[tuple[int, bytes]]:
    """(part, make(rows of it)) for each part."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
    return [(int(part[order[a]]), make(order[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True)]


def _batch(kind: int, rows: list[tuple[int, bytes]]):
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["kind", "part", "blob"])


def _prime(n: int) -> int:
    """The first prime from n on: ids in arithmetic progression still spread over so many parts."""
    n = max(n, 2)
    while any(n % i == 0 for i in range(2, int(n**0.5) + 1)):
        n += 1
    return n


PART = "kind int, part long, blob binary"


def repeated_spans(docs: DataFrame, length: int = 50, k: int = 24, hot: int = 65536) -> DataFrame:
    """Remove each byte covered by a string of length bytes that also starts in a document with a smaller doc_id.

    Texts are UTF-8 bytes; strings never cross documents, may overlap, and are judged on the input. Returns, per row, doc_id,
    n_bytes, n_removed, spans array<struct<start long, end long>> (maximal removed runs, offsets in the original) and kept
    binary (what remains, in order). An anchor of more than hot different runs is dealt by windows. A null or empty text has no bytes. Rows that share a doc_id, same text or not, are
    judged each on their own and never against each other. A null doc_id has no rank: its row stays whole and is no source.
    An empty table gives an empty result. Other columns are ignored.
    """
    rows = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    ranked = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    total = ranked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = _prime(-(-total // SHARE))
    tasks = -(-parts // 2)  # two parts a task, whatever the session's number of shuffle partitions
    tail = [8 * i for i in range(length // 8)]

    def anchors(batches):
        for b in pieces(batches):
            doc, first, last, a, w = runs(*text_bytes(column(b, "text")), length, k)
            ids = ints(b, "doc_id")[doc]
            order = np.lexsort((ids, w, a))
            a, w, d = a[order], w[order], ids[order]
            new = np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])) if len(a) else np.zeros(0, bool)
            copy = d > d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else new  # of a smaller document of this batch
            flags, where = _key(d[copy], w[copy]), d[copy]
            a, w, d = a[new], w[new], d[new]

            def make(at):
                docs_, n = np.unique(d[at], return_inverse=True)  # noqa: B023
                high = a[at] >> np.uint64(16)  # noqa: B023
                return np.int64([len(docs_), len(at)]).tobytes() + docs_.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes() + high.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + w[at].tobytes()  # noqa: B023

            yield _batch(0, _deal((a % np.uint64(parts)).astype(np.int64), make))
            yield _batch(1, _deal(where % parts, lambda at: distinct(flags[at]).tobytes()))  # noqa: B023

    def _read(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d, n = np.frombuffer(blob, np.int64, 2)
        at = 16 + 8 * d
        ref, high = np.zeros((n, 4), np.uint8), np.zeros((n, 8), np.uint8)
        ref[:, :3] = np.frombuffer(blob, np.uint8, 3 * n, at).reshape(-1, 3)
        high[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at + 3 * n).reshape(-1, 6)
        return high.view(np.uint64).ravel(), np.frombuffer(blob, np.uint64, n, at + 9 * n), np.frombuffer(blob, np.int64, d, 16)[ref.view(np.uint32).ravel()]

    def first_holder(t, starts):
        blobs, kinds, part = column(t, "blob"), ints(t, "kind"), ints(t, "part")
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            settled = [(int(part[i]), blobs[int(i)].as_py()) for i in s + np.flatnonzero(kinds[s:e] == 1)]
            yield _batch(1, settled)
            runs_ = s + np.flatnonzero(kinds[s:e] == 0)
            if not len(runs_):
                continue
            a, w, d = (np.concatenate(x) for x in zip(*(_read(blobs[int(i)].as_py()) for i in runs_), strict=True))
            order = np.lexsort((d, w, a))
            a, w, d = a[order], w[order], d[order]
            new = np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]))
            holder = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            copy = d > holder
            flags = _key(d[copy], w[copy])
            where = d[copy]
            # of first holders, anchors that several documents share
            a, d = a[new], d[new]
            cut = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            size = np.diff(np.append(cut, len(a)))
            several = np.repeat(np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut), size)
            many = np.repeat(size > hot, size) & several
            shared, crowd = _key(d[several], a[several]), _key(d[many], a[many])
            yield _batch(1, _deal(where % parts, lambda at: flags[at].tobytes()))  # noqa: B023
            yield _batch(2, _deal(d[several] % parts, lambda at: shared[at].tobytes()))  # noqa: B023
            yield _batch(5, _deal(d[many] % parts, lambda at: crowd[at].tobytes()))  # noqa: B023

    held = saved(in_groups(ranked.select("doc_id", "text").mapInArrow(trimmed(anchors), PART), ["part"], first_holder, PART, parts=tasks), "held")

    # texts meet what was found about them: control rows sort before texts within a shard
    shard = F.pmod("doc_id", F.lit(parts).cast("long"))
    texts = ranked.select(shard.alias("part"), F.lit(9).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc_id", "rid", "text")

    def meet(control: DataFrame) -> DataFrame:
        return texts.unionByName(control.select("part", "kind", "blob"), allowMissingColumns=True)

    def known(t, s, e, kind, dtype):
        kinds, blobs = ints(t.slice(s, e - s), "kind"), column(t, "blob").slice(s, e - s)
        return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(blobs[int(i)].as_py(), dtype) for i in np.flatnonzero(kinds == kind))])

    def text_rows(t, s, e):
        x = t.slice(s, e - s)
        x = x.filter(pa.array(ints(x, "kind") == 9))
        return x.combine_chunks().to_batches(), x

    def look(t, starts):
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            flags, shared, crowd = (distinct(known(t, s, e, kind, np.uint64)) for kind in (1, 2, 5))
            for b in pieces(text_rows(t, s, e)[0]):
                data, off = text_bytes(column(b, "text"))
                doc, first, last, a, w = runs(data, off, length, k)
                ids, rid = ints(b, "doc_id")[doc], ints(b, "rid")[doc]
                copy = _has(flags, _key(ids, w))
                edge = ~copy & _has(shared, _key(ids, a >> np.uint64(16)))
                span = np.stack([ids, rid, first - off[doc], last - off[doc]], 1)
                yield _batch(3, _deal(ids[copy] % parts, lambda at: span[copy][at].tobytes()))  # noqa: B023
                by_window = edge & _has(crowd, _key(ids, a >> np.uint64(16)))

                def context(at):
                    size = (last - first)[at] + length  # noqa: B023
                    return np.int64([len(at)]).tobytes() + span[at].tobytes() + data[places(first[at], size)].tobytes()  # noqa: B023

                if by_window.any():
                    size = (last - first + 1)[by_window]
                    at = places(first[by_window], size)
                    own = np.repeat(span[by_window], size, axis=0)
                    own[:, 2] = own[:, 3] = at - off[np.repeat(doc[by_window], size)]
                    h = gram_hashes(data, (length,))[0][at]
                    order = np.lexsort((own[:, 0], h))
                    at, own, h = at[order], own[order], h[order]
                    new = np.append(True, h[1:] != h[:-1])
                    # hashes of 64 bits could clash: a copy is settled here only if the bytes are the same
                    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                    copy_ = np.flatnonzero(own[:, 0] > own[lead, 0])
                    copy_ = copy_[_same(data, at[copy_], at[lead[copy_]], length)]
                    rest = np.setdiff1d(np.arange(len(at)), copy_)
                    yield _batch(3, _deal(own[copy_, 0] % parts, lambda x: own[copy_[x]].tobytes()))  # noqa: B023

                    def window(x):
                        x = rest[x]  # noqa: B023
                        return np.int64([len(x)]).tobytes() + own[x].tobytes() + data[places(at[x], np.full(len(x), length))].tobytes()  # noqa: B023

                    yield _batch(4, _deal((h[rest] % np.uint64(parts)).astype(np.int64), window))
                edge &= ~by_window
                a, first, last, span = a[edge], first[edge], last[edge], span[edge]
                yield _batch(4, _deal((a % np.uint64(parts)).astype(np.int64), context))

    found = saved(in_groups(meet(held), ["part"], look, PART, order=["kind"], parts=tasks), "found")
    discard(held)

    def suffixes(t, starts):
        blobs = column(t, "blob")
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            spans, text = [], []
            for i in range(s, e):
                x = blobs[i].as_py()
                n = int(np.frombuffer(x, np.int64, 1)[0])
                spans.append(np.frombuffer(x, np.int64, 4 * n, 8).reshape(-1, 4))
                text.append(np.frombuffer(x, np.uint8, offset=8 + 32 * n))
            span, data = np.concatenate(spans), np.concatenate(text)
            n = span[:, 3] - span[:, 2] + 1
            base = np.cumsum(n + length - 1) - (n + length - 1)
            which = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            at = base[which] + step
            # a window whose hash is alone can't repeat
            h = gram_hashes(data, (length,))[0][at]
            order = np.argsort(h)
            twin = np.zeros(len(h), bool)
            same = h[order][1:] == h[order][:-1]
            twin[order[1:][same]] = twin[order[:-1][same]] = True
            which, step, at = which[twin], step[twin], at[twin]
            if not len(at):
                continue
            padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
            be = padded[:-1]
            for shift in (1, 2, 4):
                be = (be[:-shift] << np.uint64(8 * shift)) | be[shift:]
            words = [be[at + x] for x in tail]
            for x in range(len(tail) * 8, length):
                words.append(padded[at + x])
            hit = copied(span[which, 0], words, [8] * len(tail) + [1] * (length % 8))
            which, step = which[hit], step[hit]
            if not len(which):
                continue
            cut = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (step[1:] != step[:-1] + 1)))
            end = np.append(cut[1:], len(which)) - 1
            out = np.stack([span[which[cut], 0], span[which[cut], 1], span[which[cut], 2] + step[cut], span[which[cut], 2] + step[end]], 1)
            yield _batch(3, _deal(out[:, 0] % parts, lambda at: out[at].tobytes()))  # noqa: B023

    edges = saved(in_groups(found.where("kind = 4"), ["part"], suffixes, PART, parts=tasks), "suffixes")

    def remove(t, starts):
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            span = known(t, s, e, 3, np.int64).reshape(-1, 4)
            span = span[np.argsort(span[:, 1], kind="stable")]
            for b in text_rows(t, s, e)[0]:
                data, off = text_bytes(column(b, "text"))
                rid = ints(b, "rid")
                lo, hi = np.searchsorted(span[:, 1], rid, "left"), np.searchsorted(span[:, 1], rid, "right")
                removed, spans, kept = [], [], []
                for i in range(b.num_rows):
                    own = data[off[i] : off[i + 1]]
                    if lo[i] == hi[i]:
                        removed.append(0), spans.append([]), kept.append(own.tobytes())
                        continue
                    mark = np.zeros(len(own) + 1, np.int32)
                    np.add.at(mark, span[lo[i] : hi[i], 2], 1)
                    np.add.at(mark, span[lo[i] : hi[i], 3] + length, -1)
                    gone = np.cumsum(mark)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    removed.append(int(gone.sum())), kept.append(own[~gone].tobytes())
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    shape = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    done = in_groups(meet(found.where("kind = 3").union(edges)), ["part"], remove, shape, order=["kind"], parts=tasks)
    rest = rows.where(F.col("doc_id").isNull() | (F.octet_length("text") < length))
    return done.union(rest.select("doc_id", F.octet_length("text").cast("long"), F.lit(0).cast("long"), F.array().cast("array<struct<start:long,end:long>>"), F.encode("text", "utf-8")))
