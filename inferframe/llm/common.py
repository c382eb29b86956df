"""What the operators of this subpackage share: durable intermediate tables, Arrow group streams and components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges up to this many (16 bytes each) are contracted by one executor task; beyond it the star rounds run.
ONE_TASK_EDGES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that Spark hands to a Python worker at a time (one longer row is a batch of its own).
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, not only by rows, where the session leaves Spark's 64 MB: 10,000 long texts don't fit a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def documents(docs: DataFrame) -> DataFrame:
    """doc_id long and text string only, so that other columns can't clash with an operator's own."""
    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(ident, modulus: int = 5, remainder: int = 0):
    """Whether crc32 of the id as text has this remainder; null ids are never held out."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], keep) -> DataFrame | None:
    """id, y (0 or 1) and whole text of a bounded sample: of each class the first most[class] documents in order of a hash.

    Only labels that keep (a condition on doc_id) allows are read; several labels of one document are averaged. None if there are no labels.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull())
    y = y.where(keep(F.col("id"))).groupBy("id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    picked = [y.where(F.col("y") == c).orderBy(F.xxhash64("id", F.lit(label)), "id").limit(n).collect() for c, n in most.items()]
    rows = sorted((r["id"], r["y"]) for p in picked for r in p)
    if not rows:
        return None
    chosen = docs.sparkSession.createDataFrame(rows, "id long, y int")
    return documents(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], keep, most_bytes: int = 64 << 20) -> tuple[list[str], np.ndarray]:
    """Whole texts and labels of labelled_rows() on the driver, bounded by rows and by bytes: where a class has more than its share of
    most_bytes, its longest texts are left out of the sample."""
    rows = labelled_rows(docs, labels, label, most, keep)
    if rows is None:
        return [], np.zeros(0)
    sizes = rows.select("id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()
    longest = {}
    for c in most:
        n = np.sort([r["n"] for r in sizes if r["y"] == c])
        fit = int(np.searchsorted(np.cumsum(n), most_bytes // len(most), "right"))
        longest[c] = int(n[fit - 1]) if fit else -1
    limit = F.coalesce(*[F.when(F.col("y") == c, F.lit(n)) for c, n in longest.items()], F.lit(-1))
    got = sorted(rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= limit).collect(), key=lambda r: r["id"])
    return [r["text"] or "" for r in got], np.array([r["y"] for r in got], np.float64)


# ---------------------------------------------------------------- durable tables

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir; in local mode, where that is unset (tests), under a temporary folder."""
    base = bounded(spark).sparkContext.getConf().get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that the driver and all executors share")
        base = _local.setdefault(app, tempfile.mkdtemp(prefix="inferframe-"))
    out = f"{base.rstrip('/')}/inferframe-{app}"
    if out not in _folders:
        _folders[out] = spark
    return out


_folders: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in _folders.items():
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception as e:  # the JVM may already be gone at exit
                print(f"left {path}: {e}")


#: Lets Spark remove the shuffle files of a query when it ends; without it they stay until the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


#: Bytes of input for a file of an intermediate table, where these are more files than four for each core.
FILE_INPUT = 64 << 20


def few_files(df: DataFrame) -> DataFrame:
    """df in as many partitions as its plan has, but no more than four for each core or one for each FILE_INPUT bytes that it scans: many
    shuffle partitions of a small table would each be a file. Partitions are joined within tasks, nothing is shuffled."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    scanned = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.coalesce(min(1 << 20, max(4 * df.sparkSession.sparkContext.defaultParallelism, scanned // FILE_INPUT)))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, a lost executor costs no recomputation and the shuffles go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with shuffles_go(spark):
        few_files(df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    give_back()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of saved() that no result reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._saved_path)


# ---------------------------------------------------------------- Arrow helpers


def trimmed(fn):
    """fn for mapInArrow; when a task ends, its Python worker, which lives on, gives freed memory back to the system."""

    def run(batches):
        yield from fn(batches)
        gc.collect()
        give_back()

    return run


def give_back() -> None:
    """Memory that this process has freed, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, all rows in one array, and the n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(batches, size: int = 1 << 20, rows: int = 1 << 30, column: str = "text"):
    """Record batches cut into runs of at most rows rows and about size bytes of text; one longer text is a piece of its own."""
    for b in batches:
        if b.num_rows == 0:
            continue
        _, off = text_bytes(b.column(b.schema.get_field_index(column)))
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(off, off[i] + size, "right")) - 1
            j = min(max(j, i + 1), i + rows, b.num_rows)
            yield b.slice(i, j - i)
            i = j


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct integers, ascending; a plain sort, which numpy does many times faster than unique()."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of the next."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def ints(batch, name: str) -> np.ndarray:
    c = column(batch, name)
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    return np.asarray(c.to_numpy(zero_copy_only=False))


def in_groups(df: DataFrame, keys: list[str], fn, schema: str, order: list[str] = (), parts: int | None = None) -> DataFrame:
    """Rows of equal keys (non-null longs) meet in one task, in runs; fn(table, starts) gets whole groups, several at once.

    parts is the number of tasks, where the caller knows what the groups weigh; else the session's.

    starts holds the first row of each group and the number of rows. Only the group being read and one batch are in
    memory; callers bound the size of a group by splitting it into blocks first.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []

        def key(b, i):
            return tuple(column(b, k)[i].as_py() for k in keys)

        def flush(t):
            cols = [ints(t, k) for k in keys]
            change = np.zeros(t.num_rows, bool)
            change[0] = True
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            starts = np.append(np.flatnonzero(change), t.num_rows)
            yield from fn(t, starts)

        for b in batches:
            if b.num_rows == 0:
                continue
            if held and key(b, 0) == key(held[0], 0) == key(b, b.num_rows - 1):
                held.append(b)
                continue
            last, lo = key(b, b.num_rows - 1), 0
            change = np.zeros(b.num_rows, bool)
            change[0] = True
            for k in keys:
                c = ints(b, k)
                change[1:] |= c[1:] != c[:-1]
            lo = int(np.flatnonzero(change)[-1])
            if held and lo == 0 and last == key(held[0], 0):
                held.append(b)
                continue
            whole = pa.Table.from_batches([*held, b.slice(0, lo)]) if lo or held else None
            if whole is not None and whole.num_rows:
                yield from flush(whole.combine_chunks())
            held = [b.slice(lo)]
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(trimmed(run), schema)


# ---------------------------------------------------------------- components


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges a-b: (node, smallest node of its component) for nodes that aren't their own root."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        # hook each root to the smallest root across an edge, then halve all paths until flat
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while (nxt := root[root], not np.array_equal(nxt, root))[1]:
            root = nxt
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges to (node, component), component the smallest node reachable; nodes without edges are absent.

    Large-star / small-star rounds (two joins with a pre-aggregated minimum each) until the edges are stars. As soon as
    the counted edges are few (ONE_TASK_EDGES, a fixed bound) one task contracts the rest. Every table a round reads is
    written to the shared folder, and both sides of each join are exchanged, so a hub is split by Spark's skew join.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    e = saved(edges.where((a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    state = None
    while True:
        n, h = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n <= ONE_TASK_EDGES:

            def contract(batches):
                t = [(ints(x, "a"), ints(x, "b")) for x in batches]
                if t:
                    node, root = forest(np.concatenate([x[0] for x in t]), np.concatenate([x[1] for x in t]))
                    nodes = np.concatenate([node, np.unique(root)])
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate([root, np.unique(root)]))], ["node", "component"])

            return saved(e.repartition(1).mapInArrow(trimmed(contract), "node long, component long"), "components")
        if (n, h) == state:
            return saved(e.select(a.alias("node"), b.alias("component")).union(e.select(b, b).distinct()), "components")
        state = (n, h)
        both = e.select("a", "b").union(e.select(b.alias("a"), a.alias("b")))
        m = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = saved(both.join(m, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct(), "large")
        m2 = saved(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(m2, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        old, e = e, saved(small.union(m2.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(old, m, large, m2)
