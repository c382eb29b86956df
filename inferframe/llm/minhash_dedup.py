"""MinHash near-dedup: banded candidates, sequential Bayesian verification of signatures, exact verification of sets."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, components, discard, documents, forest, in_groups, ints, pieces, places, saved, text_bytes, trimmed
from .shingles import shingle_sets


@dataclass(frozen=True)
class Settings:
    """words in a shingle; least similarity in percent; bands x rows of the signature; hashes compared at a time; miss: posterior
    probability of similarity >= least below which a pair is pruned; block: rows of a bucket that a task compares with as many others."""

    words: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 5
    batch: int = 16
    miss: float = 1e-7
    block: int = 512


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, given: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minima of hashes, one for each of the seeds, over a set."""
    a, b = given
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(out, (x[i : i + 256, None] * a + b).min(0), out=out)
    return out


def fewest_matches(total: int, batch: int, percent: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(hashes compared, fewest equal bytes at which P(similarity >= percent | data) >= miss), under a uniform prior."""
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256  # bytes of minima also agree by chance
    out = []
    for n in sorted({*range(batch, total, batch), total}):
        for m in range(n + 1):
            like = np.exp((m * np.log(p) + (n - m) * np.log1p(-p)) - (m * np.log(max(m, 0.5) / n) + (n - m) * np.log(max(n - m, 0.5) / n)))
            if like[j >= percent / 100].sum() >= miss * like.sum():
                break
        out.append((n, m))
    return tuple(out)


def survivors(sig: np.ndarray, x: np.ndarray, y: np.ndarray, bounds: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Which pairs (x, y) of rows of sig stay when batches of hashes are compared in turn."""
    alive, same, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, fewest in bounds:
        same = same + (sig[x[alive], at:n] == sig[y[alive], at:n]).sum(1)
        stay = same >= fewest
        alive, same, at = alive[stay], same[stay], n
    return alive


def _signatures(t, n: int) -> np.ndarray:
    c = column(t, "sig")
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return text_bytes(c)[0].reshape(-1, n)


def _sets(t, name: str) -> list[np.ndarray]:
    data, off = text_bytes(column(t, name))
    return [np.frombuffer(data[a:b].tobytes(), np.uint64) for a, b in zip(off[:-1], off[1:], strict=True)]


def _shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets: one by one, or by matrix products where each set is in many pairs."""
    if len(x) <= 8 * len(set(x.tolist()) | set(y.tolist())):
        out = np.zeros(len(x), np.int64)
        for n, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            c = np.concatenate([sets[i], sets[j]])
            c.sort()
            out[n] = np.count_nonzero(c[1:] == c[:-1])
        return out
    rows = np.unique(np.concatenate([x, y]))
    place = {r: k for k, r in enumerate(rows)}
    ids, inv, times = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    shared = np.flatnonzero(times > 1)
    col = np.full(len(ids), -1)
    col[shared] = np.arange(len(shared))
    c = col[inv]
    owner, c = owner[c >= 0], c[c >= 0]
    order = np.argsort(c, kind="stable")
    owner, c = owner[order], c[order]
    total = np.zeros((len(rows), len(rows)), np.float32)
    for lo in range(0, len(shared), 4096):
        a, b = np.searchsorted(c, [lo, lo + 4096])
        m = np.zeros((len(rows), 4096), np.float32)
        m[owner[a:b], c[a:b] - lo] = 1
        total += m @ m.T
    return total[[place[i] for i in x], [place[j] for j in y]].astype(np.int64)


def _listed(starts: np.ndarray, comp: np.ndarray, within: np.ndarray, left: np.ndarray, most: int = 1 << 17):
    """Pairs (x, y) of rows of different components, in runs: within a group, or of its left rows with the others."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = np.diff(starts)
    small = within[starts[:-1]] & (size <= 64)
    for m in np.unique(size[small & (size > 1)]):  # groups of one size at once
        i, j = np.triu_indices(int(m), 1)
        base = starts[:-1][small & (size == m)]
        step = max(1, most // len(i))
        held += [tuple((base[lo : lo + step, None] + c[None, :]).ravel() for c in (i, j)) for lo in range(0, len(base), step)]

    def large():
        for lo, hi in zip(starts[:-1][~small], starts[1:][~small], strict=True):
            own = np.arange(lo, hi)
            mine = own if within[lo] else own[left[lo:hi]]
            rest = own if within[lo] else own[~left[lo:hi]]
            step = max(1, most // max(1, len(rest)))
            for k in range(0, len(mine), step):
                x, y = (v.ravel() for v in np.meshgrid(mine[k : k + step], rest, indexing="ij"))
                yield (x[y > x], y[y > x]) if within[lo] else (x, y)

    run: list[tuple[np.ndarray, np.ndarray]] = []
    for x, y in chain(held, large()):
        on = comp[x] != comp[y]
        run.append((x[on], y[on]))
        if sum(len(r[0]) for r in run) >= most:
            yield tuple(np.concatenate(v) for v in zip(*run, strict=True))
            run = []
    if run:
        yield tuple(np.concatenate(v) for v in zip(*run, strict=True))


def _links(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sets reach the similarity, exactly."""
    size = np.array([len(v) for v in sets], np.int64)
    out = (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])) & (size[x] > 0) & (size[y] > 0)
    both = _shared(sets, x[out], y[out]) if out.any() else np.zeros(0, np.int64)
    out[out] = 100 * both >= percent * (size[x[out]] + size[y[out]] - both)
    return out


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents linked by Jaccard similarity of their word shingles >= settings.percent / 100, and the components of the links.

    Words are runs of bytes other than ASCII white space, with A-Z lowered. Whole texts are hashed once; texts with equal
    sets become one class. Classes that share a band of the signature are candidates, and every pair of them is judged, in two rounds:

    1. In each bucket (in blocks, in the order of signatures) each class is compared with the one before it and with the block's
       first, by batches of signature bytes under the posterior bound; survivors are verified on their full sets and joined to components.
    2. Buckets that still hold several components compare all pairs of classes of different components, in pairs of blocks; those within
       the bucket's largest component need no look. A pair that survives is listed in the first band that both share, the sets of
       the listed classes are fetched once for a pair of blocks, and the listed pairs are verified.

    No pair that no band proposed is verified, and no pair is emitted but the linear number of round 1.

    The only approximation is a missed candidate: (1 - s^rows)^bands, 7e-6 for a pair at exactly s = 0.8 and the default
    bands, plus settings.miss; every link that is used was verified on the full sets (as 64-bit hashes).

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable, itself included), kept. A null or empty text, or
    one without words, has n_shingles 0 and links with nothing. Repeated rows are returned as often as they come. Of rows that share
    a doc_id and differ in text each has the component of its own text; texts whose smallest holder is the same document are one node. A null doc_id keeps its row, with null component_id and
    kept, and links with nothing. An empty table gives an empty result. Other columns are ignored.
    """
    s = settings
    k = s.bands * s.rows
    given, bounds = seeds(k), fewest_matches(k, s.batch, s.percent, s.miss)
    docs = documents(docs)

    def hashed(batches):
        for b in pieces(batches):
            sets = shingle_sets(*text_bytes(column(b, "text")), s.words)
            keys, sigs = [], []
            for x in sets:
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                sigs.append((signature(x, given) & np.uint32(255)).astype(np.uint8).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "key", "sig"])

    every = saved(docs.mapInArrow(trimmed(hashed), "doc_id long, n_shingles long, key binary, sig binary"), "signatures")
    known = every.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = saved(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("sig").alias("sig"), F.max("n_shingles").alias("size")), "classes")
    number = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(s.bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * s.rows + 1, F.lit(s.rows))))).alias("number", "band")
    band = classes.select("rep", number)
    buckets = band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("of"), "n")
    members = saved(band.join(buckets, F.col("band") == F.col("of")).select("band", "number", "n", "rep"), "members")
    light = classes.select(F.col("rep").alias("r"), "sig", "size")

    def neighbours(t, starts):
        sig, rep, size = _signatures(t, k), ints(t, "rep"), ints(t, "size")
        first = np.repeat(starts[:-1], np.diff(starts))
        at = np.flatnonzero(np.arange(len(rep)) != first)
        x, y = np.concatenate([at - 1, first[at]]), np.concatenate([at, at])
        fit = (rep[x] != rep[y]) & (100 * np.minimum(size[x], size[y]) >= s.percent * np.maximum(size[x], size[y]))
        x, y = x[fit], y[fit]
        stay = survivors(sig, x, y, bounds)
        a, b = rep[x[stay]], rep[y[stay]]
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    block = F.pmod(F.xxhash64("rep", "band"), F.ceil(F.col("n") / (8 * s.block)).cast("long"))
    near = members.withColumn("block", block).join(light, F.col("rep") == F.col("r")).select("band", "block", "rep", "sig", "size")
    pairs = saved(in_groups(near, ["band", "block"], neighbours, "a long, b long", order=["sig", "rep"]).distinct(), "pairs")

    # a row of a repeated doc_id whose text has no words has no signature and can't be in a pair
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^ \t-\r]"))

    def sets_of(batches):
        for b in pieces(batches):
            sets = shingle_sets(*text_bytes(column(b, "text")), s.words)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    # the sets of all classes that any band proposes; a merge join at every size, as the texts are what weighs
    proposed = members.select(F.col("rep").alias("w")).distinct()
    sets = saved(texts.join(proposed.hint("merge"), F.col("doc_id") == F.col("w"), "left_semi").mapInArrow(trimmed(sets_of), "node long, shingles binary"), "sets")

    def both(batches):
        for b in pieces(batches, 4 << 20, column="sa"):
            x, y = _sets(b, "sa"), _sets(b, "sb")
            n = np.arange(len(x))
            on = np.flatnonzero(_links([*x, *y], n, n + len(x), s.percent))
            yield b.select(["a", "b"]).take(pa.array(on))

    one, two = sets.select(F.col("node").alias("na"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("nb"), F.col("shingles").alias("sb"))
    first_links = saved(pairs.join(one, F.col("a") == F.col("na")).join(two, F.col("b") == F.col("nb")).select("a", "b", "sa", "sb").mapInArrow(trimmed(both), "a long, b long"), "links")
    discard(pairs)
    joined = components(first_links)

    # round 2: buckets of several components
    at = members.join(joined, F.col("rep") == F.col("node"), "left").select("band", "number", "rep", F.coalesce("component", "rep").alias("comp"))
    shares = at.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n")).where("n > most.n")
    shares = shares.select(F.col("band").alias("of"), F.col("most.comp").alias("core"), F.ceil(F.col("most.n") / s.block).cast("long").alias("cores"), F.ceil((F.col("n") - F.col("most.n")) / s.block).cast("long").alias("others"))
    rows = at.join(shares, F.col("band") == F.col("of")).join(light, F.col("rep") == F.col("r"))
    inner, hashed_rep = F.col("comp") == F.col("core"), F.xxhash64("rep", "band")
    rows = rows.withColumn("block", F.when(inner, F.pmod(hashed_rep, "cores")).otherwise(F.col("cores") + F.pmod(hashed_rep, "others")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(inner, F.col("cores")).otherwise(F.lit(0)).cast("long"), F.col("cores") + F.col("others") - 1)))
    rows = rows.select("band", "number", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "comp", "rep", "sig", "size")

    def compare(t, starts):
        sig, rep, size, comp = _signatures(t, k), ints(t, "rep"), ints(t, "size"), ints(t, "comp")
        band_, number_, i, j, block_ = (ints(t, c) for c in ("band", "number", "i", "j", "block"))
        found = []
        for x, y in _listed(starts, comp, i == j, block_ == i):
            fit = (rep[x] != rep[y]) & (100 * np.minimum(size[x], size[y]) >= s.percent * np.maximum(size[x], size[y]))
            x, y = x[fit], y[fit]
            stay = survivors(sig, x, y, bounds)
            x, y = x[stay], y[stay]
            shared = (sig[x] == sig[y]).reshape(-1, s.bands, s.rows).all(2)  # an earlier band that both share has the pair
            first = ~(shared & (np.arange(s.bands) < number_[x, None])).any(1)
            found.append((x[first], y[first]))
        if not found:
            return
        x, y = (np.concatenate(v) for v in zip(*found, strict=True))
        x, y = np.concatenate([x, y]), np.concatenate([y, x])  # a row for each class that is listed, with its partners
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        cut = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else x
        own = x[cut]
        with_ = pa.ListArray.from_arrays(pa.array(np.append(cut, len(x)).astype(np.int32)), pa.array(rep[y]))
        yield pa.RecordBatch.from_arrays([pa.array(v[own]) for v in (band_, i, j, rep, comp)] + [with_], ["band", "i", "j", "rep", "comp", "partners"])

    listed = saved(in_groups(rows, ["band", "i", "j"], compare, "band long, i long, j long, rep long, comp long, partners array<long>"), "listed")

    def verify(t, starts):
        rep, comp, sets, out = ints(t, "rep"), ints(t, "comp"), _sets(t, "shingles"), []
        partners = column(t, "partners").combine_chunks()
        edges, flat = partners.offsets.to_numpy(), partners.values.to_numpy()
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            own = rep[lo:hi]
            root = np.unique(comp[lo:hi], return_inverse=True)[1]
            order = np.argsort(own, kind="stable")
            x = np.repeat(np.arange(hi - lo), np.diff(edges[lo : hi + 1]))
            want = flat[edges[lo] : edges[hi]]
            a, b = np.searchsorted(own[order], want, "left"), np.searchsorted(own[order], want, "right")
            x, y = np.repeat(x, b - a), order[places(a, b - a)]  # more than one row of a repeated doc_id
            half = own[x] < own[y]
            x, y = x[half], y[half]
            for p in range(0, len(x), 4096):
                u, v = x[p : p + 4096], y[p : p + 4096]
                apart = root[u] != root[v]  # joined by now
                u, v = u[apart], v[apart]
                on = _links(sets[lo:hi], u, v, s.percent)
                u, v = u[on], v[on]
                out.append((own[u], own[v]))
                if len(u):
                    node, low = forest(root[u], root[v])
                    to = np.arange(int(root.max()) + 1)
                    to[node] = low
                    root = to[root]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[n] for o in out]) if out else np.zeros(0, np.int64)) for n in (0, 1)], ["a", "b"])

    more = in_groups(listed.join(sets, F.col("rep") == F.col("node")).drop("node"), ["band", "i", "j"], verify, "a long, b long")
    linked = components(first_links.union(more))
    final = saved(classes.join(linked, F.col("rep") == F.col("node"), "left").select(F.col("key").alias("k"), F.coalesce("component", "rep").alias("low")), "final")
    slim = every.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    out = slim.where(F.col("key").isNotNull()).join(final, F.col("key") == F.col("k")).select("doc_id", "n_shingles", F.col("low").alias("component_id"))
    out = out.union(slim.where(F.col("key").isNull()).select("doc_id", "n_shingles", F.col("doc_id")))
    discard(classes, members, first_links, listed, sets, joined, linked)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
