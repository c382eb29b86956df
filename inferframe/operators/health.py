"""Server health from a log of probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def health_states(probes: DataFrame, server: str, order: list[str], ok: Column, max_failures: int = 5, bucket: Column | None = None) -> DataFrame:
    """Add streak (consecutive failures so far), healthy and healthy_before (at the server's probe before; every server starts healthy) to each probe.

    A success starts a new run of probes; a server is unhealthy from the max_failures-th failure in a run on, and one
    success makes it healthy again. bucket, which has to ascend with order (an hour, a range of ids), cuts each server's probes into pieces that are
    numbered apart; only a row for each bucket enters the carry from piece to piece, so a server with very many probes is not in one task.
    """
    df = probes.withColumn("_ok", ok.cast("int")).withColumn("_bucket", F.lit(0) if bucket is None else bucket)
    w = W.partitionBy(server, "_bucket").orderBy(*order)
    df = df.withColumn("_run", F.sum("_ok").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    within = W.partitionBy(server, "_bucket", "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("_streak", F.sum(1 - F.col("_ok")).over(within))
    # what a bucket leaves behind: its failures after its last success, or all of them on top of what came in
    last = df.groupBy(F.col(server).alias("_s"), F.col("_bucket").alias("_b")).agg(F.max("_run").alias("_oks"), F.max(F.struct(F.col("_run"), F.col("_streak"))).alias("_end"))
    by = W.partitionBy("_s").orderBy("_b")
    last = last.withColumn("_group", F.sum(F.when(F.col("_oks") > 0, 1).otherwise(0)).over(by))
    left = F.sum("_end._streak").over(W.partitionBy("_s", "_group").orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow))
    carry = last.withColumn("_left", left).select("_s", "_b", F.lag("_left", 1, 0).over(by).alias("_in"))
    df = df.join(carry, F.col(server).eqNullSafe(F.col("_s")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    df = df.withColumn("streak", (F.col("_streak") + F.when(F.col("_run") == 0, F.col("_in")).otherwise(0)).cast("bigint"))
    before = F.coalesce(F.lag("streak").over(w), F.col("_in"))
    return df.withColumn("healthy_before", before < max_failures).withColumn("healthy", F.col("streak") < max_failures).drop("_ok", "_run", "_bucket", "_streak", "_s", "_b", "_in")


def transitions(states: DataFrame) -> DataFrame:
    """Probes at which a server's health changed."""
    return states.where(F.col("healthy_before") != F.col("healthy"))
