"""Statistics of runs, servers and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import routing


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def run_summary(requests: DataFrame, ok: Column, tokens: Column, retries: Column) -> DataFrame:
    """One row: total, completed, failed, retried, success_rate, total_tokens."""
    one = requests.agg(
        F.count("*").alias("total"), F.coalesce(F.sum(ok.cast("bigint")), F.lit(0)).alias("completed"),
        F.coalesce(F.sum((~ok).cast("bigint")), F.lit(0)).alias("failed"), F.coalesce(F.sum(retries.cast("bigint")), F.lit(0)).alias("retried"),
        F.coalesce(F.sum(F.coalesce(tokens, F.lit(0)).cast("bigint")), F.lit(0)).alias("total_tokens"),
    )
    return one.withColumn("success_rate", ratio(F.col("completed"), F.col("total")))


def server_stats(log: DataFrame, server: Column, ok: Column, cost: Column, active: Column | None = None) -> DataFrame:
    """Per server: success, error, success_rate, active, inflight_cost, effective_load. cost is a decimal, so that sums don't depend on order."""
    s = log.groupBy(server.alias("server")).agg(
        F.sum(ok.cast("bigint")).alias("success"), F.sum((~ok).cast("bigint")).alias("error"),
        F.sum(cost).cast("double").alias("inflight_cost"), (active if active is not None else F.count("*")).cast("bigint").alias("active"),
    )
    rate = routing.success_rate(F.col("success"), F.col("error"))
    return s.withColumn("success_rate", rate).withColumn("effective_load", routing.effective_load(F.col("active"), F.col("inflight_cost"), rate))


def mean_success_rate(servers: DataFrame, window: int) -> DataFrame:
    """Mean rate of the servers with enough history; null if there are none."""
    n, rate = F.col("success") + F.col("error"), routing.success_rate(F.col("success"), F.col("error"))
    return servers.agg(F.avg(F.when(n >= window, rate)).alias("mean_success_rate"), F.count(F.when(n >= window, 1)).alias("reliable_servers"))


def progress(log: DataFrame, bucket: Column, done: Column, failed: Column, total: int | None = None) -> DataFrame:
    """Per bucket of time: completed, failed, their running totals, percentage (null without a total), success_rate.

    The running totals go over one row for each bucket; the rows of the log are summed before.
    """
    per = log.groupBy(bucket.alias("bucket")).agg(F.sum(done.cast("bigint")).alias("completed"), F.sum(failed.cast("bigint")).alias("failed"))
    w = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    per = per.withColumn("completed_so_far", F.sum("completed").over(w)).withColumn("failed_so_far", F.sum("failed").over(w))
    share = F.col("completed_so_far") * F.lit(100.0) / F.lit(total) if total else F.lit(None).cast("double")
    return per.withColumn("percentage", share).withColumn("success_rate", progress_rate(F.col("completed_so_far"), F.col("failed_so_far"), F.lit(total) if total else None))


def progress_rate(completed: Column, failed: Column, total: Column | None = None) -> Column:
    """Share that succeeded: of the total if it is known, else of what is completed."""
    if total is not None:
        return ratio(completed, total)
    return F.when(completed > 0, (completed - failed) / completed).otherwise(F.lit(0.0))


def eta_seconds(completed: Column, total: Column, rate: Column) -> Column:
    return F.when(rate > 0, (total - completed) / rate)
