"""File sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, project
from ..work import exists
from .paths import mirrored

JSON = {"ignoreNullFields": "false"}


def json_lines(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row as one line of compact JSON in value. model_output and additional_data hold JSON text and go in as they are.

    Nulls are written, but an error that is null is left out, and so are additional_data in the minimal projection. carry: columns
    that stay beside the line.
    """
    loose = {"error"} if "model_output" in df.columns else {"error", "additional_data"}

    def pair(c: str) -> Column:
        x, name = F.col(f"`{c}`"), json.dumps(c, ensure_ascii=False)
        text = F.coalesce(x, F.lit("null")) if c in ("model_output", "additional_data") else F.regexp_extract(F.to_json(F.struct(x.alias("x")), JSON), r'(?s)^\{"x":(.*)\}$', 1)
        body = F.concat(F.lit(f"{name}:"), text)
        return F.when(x.isNotNull(), body) if c in loose else body

    line = F.concat(F.lit("{"), F.concat_ws(",", *[pair(c) for c in df.columns if c not in carry]), F.lit("}"))
    return df.select(line.alias("value"), *carry)


def shaped(results: DataFrame, projection: str = "full", fields: list[str] | None = None, timestamp: bool | None = None, carry: tuple[str, ...] = (), form: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The projection that a sink writes; a timestamp by default only in the full one. form, a user's own shape, takes its place; it keeps the columns that start with _."""
    if form is not None:
        return form(results)
    if projection not in ("full", "minimal"):
        raise ValueError(f"unknown projection {projection}")
    stamp = projection == "full" if timestamp is None else timestamp
    out = project.full(results, stamp, carry) if projection == "full" else project.minimal(results, carry)
    if projection == "minimal" and stamp:
        out = out.withColumn("timestamp", project.now())
    return project.only(out, fields if fields is None else [*fields, *carry])


def write_jsonl(results: DataFrame, path: str, append: bool = True, **shape) -> None:
    """JSONL part files under path."""
    json_lines(shaped(results, **shape)).write.mode("append" if append else "overwrite").text(path)


def batch_jsonl(path: str, **shape) -> Callable[[DataFrame, int], None]:
    """A sink for streams: each micro-batch has its own folder below path, which a repeated batch replaces."""
    return lambda df, batch_id: json_lines(shaped(df, **shape)).write.mode("overwrite").text(f"{path.rstrip('/')}/batch={batch_id}")


def chunk_lines(spark: SparkSession, path: str, num_chunks: int) -> DataFrame:
    """Lines (value) of the outputs of all chunks of a path, in the order of the chunks (chunk); a chunk that hasn't run yet is an error."""
    out = None
    for i in range(num_chunks):
        p = chunks.chunk_path(path, num_chunks, i)
        if not exists(spark, p):
            raise FileNotFoundError(f"no output of chunk {i} at {p}")
        one = spark.read.text(p).select(F.lit(i).alias("chunk"), "value")
        out = one if out is None else out.union(one)
    return out


def merge_chunks(spark: SparkSession, path: str, num_chunks: int, append: bool = False) -> None:
    """One output under path from those of all chunks."""
    chunk_lines(spark, path, num_chunks).select("value").write.mode("append" if append else "overwrite").text(path)


def write_csv(results: DataFrame, path: str, fields: list[str] | None = None, append: bool = True, encoding: str = "UTF-8") -> None:
    """CSV part files with headers; earlier results stay."""
    rows = project.csv_rows(results, fields)
    rows.write.mode("append" if append else "overwrite").csv(path, header=True, encoding=encoding, quote='"', escape='"', emptyValue="")


def write_json(results: DataFrame, path: str, pretty: bool = True, **shape) -> None:
    """One JSON array in one file under path, for results that must be one document. JSONL is for large results.

    Tasks write the entries as text, in parallel; the driver then puts the parts' bytes behind one another through a small buffer, and parses nothing.
    Each entry begins on a line of its own, so that sources.files.completed can split the file.
    """

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(0).to_pylist():
                if v is None:
                    continue
                if pretty:
                    v = "\n".join("  " + x for x in json.dumps(json.loads(v), indent=2, ensure_ascii=False).split("\n"))
                out.append(",\n" + v)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    spark, path = results.sparkSession, path.rstrip("/")
    folder, slash, _ = path.rpartition("/")
    stage = f"{folder}{slash}_staging-{uuid.uuid4().hex[:12]}"
    json_lines(shaped(results, **shape)).mapInArrow(run, "value string").write.option("compression", "none").text(stage)
    _as_one(spark, stage, path)


def _as_one(spark: SparkSession, stage: str, root: str) -> None:
    """The parts below stage, each entry after a comma, as one array in the one file under root; takes the place of what is there."""
    jvm = spark.sparkContext._jvm
    path, copy = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.io.IOUtils.copyBytes
    fs = path(stage).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(((p.getPath().getName(), p.getLen()) for p in fs.listStatus(path(stage))), key=lambda p: (len(p[0]), p[0]))
    whole, first = path(f"{stage}/_whole"), True
    out = fs.create(whole, True)
    try:
        out.write(b"[")
        for name, length in parts:
            if length == 0 or not name.startswith("part-"):
                continue
            part = fs.open(path(f"{stage}/{name}"))
            try:
                if first:
                    part.read()  # its first comma
                copy(part, out, 1 << 20, False)
            finally:
                part.close()
            first = False
        out.write(b"]\n")
    finally:
        out.close()
    if fs.exists(path(root)) and not fs.getFileStatus(path(root)).isDirectory():
        fs.delete(path(root), False)
    fs.mkdirs(path(root))
    old = [p.getPath() for p in fs.listStatus(path(root))]
    to = path(f"{root}/part-00000-{uuid.uuid4()}.txt")
    if not fs.rename(whole, to):
        raise OSError(f"can't rename {whole.toString()} to {to.toString()}")
    for p in old:
        fs.delete(p, True)
    fs.create(path(f"{root}/_SUCCESS"), True).close()
    fs.delete(path(stage), True)


def show(results: DataFrame, details: bool = False, separator: str = "-" * 60) -> None:
    """Print results one after another, without holding them all."""
    for r in project.console_lines(results, details).toLocalIterator():
        print(f"{separator}\n{r['value']}\n{separator}\n")


def write_mirrored(results: DataFrame, output_dir: str, filename: str | None = None, pattern: str = "result.jsonl", preserve: bool = True, place: Column | None = None, **shape) -> None:
    """JSONL files below output_dir in folders like those of the sources, or at place, a column of paths below output_dir.

    Rows of a path are brought together by a rebalance, which splits a path that holds very many rows over several tasks. Spark's own
    writer and committer write to a staging folder by path; the driver then renames files, which moves no data. The first file of a path
    gets the path's name, further ones (large paths, later runs) a number before the suffix.
    """
    spark = results.sparkSession
    known = F.col("source_file").isNotNull() & (F.col("source_file") != "")
    path = F.when(known, mirrored("", F.col("source_file"), F.coalesce(F.col("source_dir"), F.lit("")), filename, pattern, preserve)).otherwise(F.lit(f"/{pattern}"))
    if place is not None:
        path = F.coalesce(F.concat(F.lit("/"), F.ltrim(place, F.lit("/"))), path)
    lines = json_lines(shaped(results.withColumn("_path", path), carry=("_path",), **shape), ("_path",))
    stage = f"{output_dir.rstrip('/')}/_staging-{uuid.uuid4().hex[:12]}"
    lines.hint("rebalance", "_path").write.partitionBy("_path").text(stage)
    _publish(spark, stage, output_dir.rstrip("/"))


def _publish(spark: SparkSession, stage: str, root: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(stage).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(path(stage)):
        name = folder.getPath().getName()
        if not name.startswith("_path="):
            continue
        target = root + jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[len("_path=") :])
        stem, dot, suffix = target.rpartition(".") if "." in target.rpartition("/")[2] else (target, "", "")
        fs.mkdirs(path(target).getParent())
        n = 0
        for part in sorted(p.getPath().toString() for p in fs.listStatus(folder.getPath())):
            to = path(target)
            while fs.exists(to):
                n += 1
                to = path(f"{stem}-{n:05d}{dot}{suffix}")
            if not fs.rename(path(part), to):
                raise OSError(f"can't rename {part} to {to.toString()}")
    fs.delete(path(stage), True)
