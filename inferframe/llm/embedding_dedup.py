"""Embedding near-dedup: an exact metric range join over pivot cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, components, in_groups, ints, saved, trimmed


def _matrix(col, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _linked(x: np.ndarray, y: np.ndarray, least: float, rows: int = 256) -> np.ndarray:
    """Pairs of unit rows with cosine >= least; sums that a blocked product leaves within rounding are summed again exactly."""
    out = np.empty((len(x), len(y)), bool)
    for lo in range(0, len(x), rows):
        c = x[lo : lo + rows] @ y.T
        out[lo : lo + rows] = c >= least
        for i, j in zip(*np.nonzero(np.abs(c - least) < 1e-13), strict=True):
            out[lo + i, j] = math.fsum(x[lo + i] * y[j]) >= least
    return out


def _dot(m: np.ndarray, c: np.ndarray, rows: int = 256) -> np.ndarray:
    """Sums of c over the columns that are set in each row of m."""
    return np.concatenate([m[k : k + rows] @ c for k in range(0, len(m), rows)] or [np.zeros(0, np.int64)])


def _lowest(m: np.ndarray, low: np.ndarray, rows: int = 256) -> np.ndarray:
    """For each row of m the smallest of low over its columns that are set."""
    big = np.iinfo(np.int64).max
    return np.concatenate([np.where(m[k : k + rows], low[None, :], big).min(1, initial=big) for k in range(0, len(m), rows)] or [np.zeros(0, np.int64)])


def embedding_components(vectors: DataFrame, least: float = 0.98, cell_rows: int = 1000, max_pivots: int = 4096, same_label: bool = True, block_numbers: int = 1 << 19) -> DataFrame:
    """Vectors linked by cosine >= least, in double precision, and the components of the links.

    vectors has vec_id long, embedding array<float|double> and label. Equal vectors are one class with a count. Each
    (label, dimension) gets one pivot for every cell_rows classes, max_pivots in all. A class lives in the cell of its
    nearest pivot; by the triangle inequality, and by the distance to the plane halfway between two pivots, only classes
    near a boundary are also sent to higher-numbered cells, so each pair is compared in exactly one cell. Cells with more than block_numbers
    components of vectors are split into blocks, and block pairs are independent tasks. Beyond max_pivots * cell_rows classes cells grow
    with the table: a class is then sent to as many block pairs as its cell has blocks.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included) and
    kept. A vector that is null, empty, zero, or holds a null or non-finite component, or whose label is null, links with
    nothing; vectors of different dimension never link. Repeated rows are rows of their own and link with each other; rows
    that share a vec_id with different vectors are one node of the components, each with its own n_links; a null vec_id keeps its row, with null component_id and kept. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    label = F.col("label").cast("string") if same_label else F.lit("")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    v = v.withColumn("x", F.when(F.coalesce(sound, F.lit(False)), F.col("x")))
    good = v.where(F.col("x").isNotNull() & F.col("vec_id").isNotNull())
    classes = saved(good.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("x")).withColumn("cid", F.xxhash64("label", "x")), "classes")

    # pivots: a bounded number, chosen by hash, at most one for each cell_rows classes of a (label, dimension)
    n = classes.count()
    share = max(cell_rows, math.ceil(n / max(1, max_pivots)))
    chosen = classes.where(F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(share)) == 0).orderBy(F.xxhash64("rep")).limit(2 * max_pivots).select("label", "dim", "x").collect()
    pivots: dict[tuple[str, int], np.ndarray] = {}
    for key in {(r["label"], r["dim"]) for r in chosen}:
        p = _unit(np.array([r["x"] for r in chosen if (r["label"], r["dim"]) == key]))
        pivots[key] = np.unique(p, axis=0)
    given = spark.sparkContext.broadcast(pivots)
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9

    def deal(batches):
        for b in batches:
            dims, labels = ints(b, "dim"), np.asarray(column(b, "label").to_pylist(), object)
            out = []
            for key in set(zip(labels.tolist(), dims.tolist(), strict=True)):
                at = np.flatnonzero((labels == key[0]) & (dims == key[1]))
                p = given.value.get(key)
                if p is None:
                    out.append((at, np.zeros(len(at), int), np.ones(len(at), bool)))
                    continue
                u = _unit(_matrix(column(b, "x").take(pa.array(at)), key[1]))
                c = u @ p.T
                home = c.argmax(1)
                best = c[np.arange(len(at)), home][:, None]
                gap = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))[home]  # pivot to pivot
                near = (best - c) <= eps * gap + 1e-9  # distance to the plane between the pivots
                near &= np.sqrt(np.maximum(0, 2 - 2 * c)) <= np.sqrt(np.maximum(0, 2 - 2 * best)) + 2 * eps  # triangle inequality
                near &= np.arange(len(p)) > home[:, None]
                out.append((at, home, np.ones(len(at), bool)))
                i, j = np.nonzero(near)
                out.append((at[i], j, np.zeros(len(i), bool)))
            at = np.concatenate([o[0] for o in out])
            yield pa.RecordBatch.from_arrays(
                [column(b, "label").take(pa.array(at)), pa.array(dims[at].astype(np.int32)), pa.array(np.concatenate([o[1] for o in out]).astype(np.int64)), pa.array(np.concatenate([o[2] for o in out])), column(b, "rep").take(pa.array(at)), column(b, "cid").take(pa.array(at)), column(b, "copies").take(pa.array(at)), column(b, "x").take(pa.array(at))],
                ["label", "dim", "pivot", "home", "rep", "cid", "copies", "x"],
            )

    dealt = classes.select("label", "dim", "rep", "cid", "copies", "x").mapInArrow(trimmed(deal), "label string, dim int, pivot long, home boolean, rep long, cid long, copies long, x array<double>")
    dealt = saved(dealt.withColumn("cell", F.xxhash64("label", "dim", "pivot")), "dealt")
    sizes = saved(dealt.groupBy("cell").agg(F.ceil(F.count("*") * F.max("dim") / block_numbers).cast("int").alias("blocks")), "sizes")
    rows = dealt.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("long"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    rows = rows.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "home", "rep", "cid", "copies", "dim", "label", "pivot", "x")

    def compare(t, starts):
        reps, cids, blocks, home, copies, dims = ints(t, "rep"), ints(t, "cid"), ints(t, "block"), ints(t, "home").astype(bool), ints(t, "copies"), ints(t, "dim")
        labels, pivot = np.asarray(column(t, "label").to_pylist(), object), ints(t, "pivot")
        first = ints(t, "i")
        got = ([], [], [], [])
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            for dim, lab, piv in {(dims[k], labels[k], pivot[k]) for k in range(s, e)} if e > s else ():  # one, but for a clash of hashes
                at = np.arange(s, e)[(dims[s:e] == dim) & (labels[s:e] == lab) & (pivot[s:e] == piv)]
                u = _unit(_matrix(column(t, "x").take(pa.array(at)), int(dim)))
                h, left, c, r, ids = home[at], blocks[at] == first[s], copies[at], reps[at], cids[at]
                within = bool(left.all())
                a, o = (np.arange(len(at)), np.arange(len(at))) if within else (np.flatnonzero(left), np.flatnonzero(~left))
                m = _linked(u[a], u[o], least)
                m &= h[a][:, None] | h[o][None, :]
                if within:
                    np.fill_diagonal(m, False)
                links = np.zeros(len(at), np.int64)
                links[a] += _dot(m, c[o])
                if not within:
                    links[o] += _dot(m.T, c[a])
                low = r.copy()
                while True:  # smallest id reachable inside this block pair
                    old = low.copy()
                    low[a] = np.minimum(low[a], _lowest(m, low[o]))
                    low[o] = np.minimum(low[o], _lowest(m.T, low[a]))
                    if (low == old).all():
                        break
                for k, x in zip(got, (r, ids, links, low), strict=True):
                    k.append(x[links > 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in got], ["rep", "cid", "links", "low"])

    found = saved(in_groups(rows, ["cell", "i", "j"], compare, "rep long, cid long, links long, low long"), "found")
    reached = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    counts = saved(found.groupBy("rep", "cid").agg(F.sum("links").alias("links")), "links")
    of_class = saved(
        classes.select("label", "x", "rep", "cid", "copies").join(counts, ["rep", "cid"], "left").join(reached.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(F.col("label").alias("l"), F.col("x").alias("y"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "of_class",
    )
    linked = good.join(of_class, (F.col("label") == F.col("l")) & (F.col("x") == F.col("y"))).select("vec_id", "n_links", "component_id")
    alone = v.where(F.col("x").isNull() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
