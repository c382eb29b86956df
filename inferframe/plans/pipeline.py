"""The batch pipeline: source, resume, model, sink, and its bookkeeping."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import response
from ..operators import resume, stats
from ..work import exists

log = logging.getLogger(__name__)
Model = Callable[[DataFrame], DataFrame]
Sink = Callable[[DataFrame], None]


@dataclass(frozen=True)
class Lifecycle:
    """Calls around a run, on the driver. on_start gets the work folder; on_source_complete, for each source file with pending rows, its name (None for rows
    without one), its completed and its failed rows; on_complete the summary; on_error the error, which then goes on. An error of a call is logged, as a report mustn't stop the work."""

    on_start: Callable[[str], None] | None = None
    on_source_complete: Callable[[str | None, int, int], None] | None = None
    on_complete: Callable[[dict], None] | None = None
    on_error: Callable[[Exception], None] | None = None


def tell(call: Callable | None, *values) -> None:
    try:
        if call is not None:
            call(*values)
    except Exception:
        log.exception("lifecycle call")


BACKENDS = ("legacy_output_scan", "bitmap")


@dataclass
class Pipeline:
    """requests -> those not done -> model -> results table -> sink -> resume log.

    requests: schema.REQUEST; model: REQUEST to RESULT rows; sink: writes results. work is a folder that the cluster shares. There a run's
    results are written once, before the sink and the statistics read them, so that the model isn't asked twice; and the resume log
    lies there, one row for each finished request, appended only after the sink is done.

    backend: "legacy_output_scan" keeps the log as rows. "bitmap" keeps rows with a position (source_file, line_num, item_idx) as bitmaps, 4 KiB for up to
    32,768 lines, and only others as rows; what finished outputs tell (done) counts for rows without a position.
    """

    requests: DataFrame
    model: Model
    sink: Sink
    work: str
    done: DataFrame | None = None  # further finished request_ids, from an output scan
    resume: bool = True
    keep: Callable[[DataFrame], DataFrame] = field(default=lambda r: r)  # which results go to the sink
    backend: str = "legacy_output_scan"
    lifecycle: Lifecycle = Lifecycle()

    def __post_init__(self):
        if self.backend not in BACKENDS:
            raise ValueError(f"unknown resume backend {self.backend}: one of {', '.join(BACKENDS)}")

    def log_path(self) -> str:
        return f"{self.work.rstrip('/')}/resume"

    def pending(self) -> DataFrame:
        spark = self.requests.sparkSession
        if not self.resume:
            return self.requests
        out = self.requests
        if exists(spark, self.log_path()):
            out = resume.pending(out, spark.read.schema(LOG).parquet(self.log_path()))
        if self.backend == "bitmap" and exists(spark, self.map_path()):
            out = resume.pending_by_bitmap(out, resume.merged(spark.read.parquet(self.map_path())))
        if self.done is not None:
            by_id = resume.pending_by_id(out, self.done)
            if self.backend != "bitmap":
                return by_id
            placed = F.col("source_file").isNotNull() & F.col("line_num").isNotNull() & F.col("item_idx").isNotNull()
            ids = self.done.select(F.col("request_id").alias("_done"))
            return out.join(ids, ~placed & (F.col("request_id") == F.col("_done")), "left_anti")
        return out

    def map_path(self) -> str:
        return f"{self.work.rstrip('/')}/bitmaps"

    def _finish(self, good: DataFrame) -> None:
        log = good.select("request_id", "source_file", "line_num", "item_idx")
        if self.backend == "bitmap":
            placed = F.col("source_file").isNotNull() & F.col("line_num").isNotNull() & F.col("item_idx").isNotNull()
            resume.bitmaps(log.where(placed)).write.mode("append").parquet(self.map_path())
            log = log.where(~placed)
        log.write.mode("append").parquet(self.log_path())

    def run(self) -> dict:
        """Returns the summary: total (queued for the model), completed, failed, retried, success_rate, total_tokens, skipped (done before, or
        null without resume) and results, the path of the results table. The skipped are counted by one more scan of the source, if anything was done before."""
        tell(self.lifecycle.on_start, self.work)
        try:
            out = self._run()
        except Exception as e:
            tell(self.lifecycle.on_error, e)
            raise
        tell(self.lifecycle.on_complete, out)
        return out

    def _run(self) -> dict:
        spark = self.requests.sparkSession
        path = f"{self.work.rstrip('/')}/results-{uuid.uuid4().hex[:12]}"
        pending = self.pending()
        answered = self.model(pending)
        answered.write.parquet(path)
        results = spark.read.schema(answered.schema).parquet(path)
        good = results.where("error is null")
        self.sink(self.keep(good))
        self._finish(good)
        if self.lifecycle.on_source_complete is not None:
            failed = F.sum(F.col("error").isNotNull().cast("bigint"))
            for r in results.groupBy("source_file").agg(F.count("*").alias("n"), failed.alias("failed")).toLocalIterator():
                tell(self.lifecycle.on_source_complete, r["source_file"], r["n"] - r["failed"], r["failed"])
        out = summary(results)
        skipped = 0 if pending is self.requests else self.requests.count() - out["total"]
        return out | {"skipped": skipped if self.resume else None, "results": path}


LOG = "request_id string, source_file string, line_num bigint, item_idx int"


def summary(results: DataFrame) -> dict:
    retries = F.greatest(F.size("attempts") - 1, F.lit(0)) if "attempts" in results.columns else F.lit(0)
    tokens = response.total_tokens(response.output("model_output"))
    return stats.run_summary(results, F.col("error").isNull(), tokens, retries).first().asDict()


def compacted(spark: SparkSession, work: str) -> DataFrame:
    """What is done by position, as bitmaps: those of bitmap runs and the rows of other runs' logs."""
    base = work.rstrip("/")
    log = resume.bitmaps(spark.read.schema(LOG).parquet(f"{base}/resume").where("line_num is not null"))
    return resume.merged(log, spark.read.parquet(f"{base}/bitmaps")) if exists(spark, f"{base}/bitmaps") else log
