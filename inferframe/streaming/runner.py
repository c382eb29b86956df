"""The pipeline over a folder that files keep arriving in."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize, resume
from ..plans.pipeline import LOG, Lifecycle, tell
from ..sources import files
from ..work import exists as _exists


@dataclass(frozen=True)
class Stream:
    """files_per_batch bounds what one micro-batch takes on; interval None processes what is there and stops."""

    input_dir: str
    pattern: str
    work: str  # shared folder for the checkpoint and the resume log
    files_per_batch: int = 1000
    interval: str | None = None


def run_stream(spark: SparkSession, s: Stream, model: Callable[[DataFrame], DataFrame], sink: Callable[..., None], fields: normalize.Fields = normalize.Fields(), hooks: normalize.Hooks = normalize.Hooks(), lifecycle: Lifecycle = Lifecycle()) -> StreamingQuery:
    """Each micro-batch of new files: number its lines, build requests, leave out what is done, ask the model, write, then log.

    The results of a batch are written once under work before the sink reads them. A batch that Spark repeats after a failure finds its
    finished requests in the resume log, so the model isn't asked for them again. A batch that failed between the sink and the log is written again:
    a sink of two parameters gets the batch's number and can replace what it wrote (sinks.files.batch_jsonl does); one of one parameter may write twice.

    lifecycle: on_start at the stream's start, then for each micro-batch on_source_complete for its files, on_complete with batch, completed and failed, or on_error.
    """
    numbered = len(inspect.signature(sink).parameters) > 1
    tell(lifecycle.on_start, s.work)
    work = s.work.rstrip("/")
    rows = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", s.pattern).option("maxFilesPerTrigger", s.files_per_batch).text(s.input_dir)
    rows = rows.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))

    def batch(df: DataFrame, batch_id: int) -> None:
        try:
            done = one(df, batch_id)
        except Exception as e:
            tell(lifecycle.on_error, e)
            raise
        tell(lifecycle.on_complete, done)

    def one(df: DataFrame, batch_id: int) -> dict:
        own = df.sparkSession
        lines = files.placed(own, files.numbered(df), s.input_dir, True)
        requests = normalize.requests(normalize.fan_out(lines, fields.id), fields, hooks)
        if _exists(own, f"{work}/resume"):
            requests = resume.pending(requests, own.read.schema(LOG).parquet(f"{work}/resume"))
        answered = model(requests)
        path = f"{work}/results/batch-{batch_id}"
        answered.write.mode("overwrite").parquet(path)
        results = own.read.schema(answered.schema).parquet(path)
        good = results.where("error is null")
        sink(good, batch_id) if numbered else sink(good)
        good.select("request_id", "source_file", "line_num", "item_idx").write.mode("append").parquet(f"{work}/resume")
        total = failed = 0
        if lifecycle.on_source_complete is not None or lifecycle.on_complete is not None:
            for r in results.groupBy("source_file").agg(F.count("*").alias("n"), F.sum(F.col("error").isNotNull().cast("bigint")).alias("failed")).toLocalIterator():
                tell(lifecycle.on_source_complete, r["source_file"], r["n"] - r["failed"], r["failed"])
                total, failed = total + r["n"], failed + r["failed"]
        return {"batch": batch_id, "completed": total - failed, "failed": failed}

    w = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{work}/checkpoint")
    return (w.trigger(processingTime=s.interval) if s.interval else w.trigger(availableNow=True)).start()
