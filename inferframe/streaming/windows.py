"""Windowed progress of a stream of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_time(log: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Watermark on a time column; timestamps without a zone count in the session's."""
    return log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(log: DataFrame, width: str, ok, ts: str = "ts") -> DataFrame:
    """Attempts and failures per window of fixed width."""
    g = log.groupBy(F.window(ts, width)).agg(F.count("*").alias("attempts"), F.sum((~ok).cast("bigint")).alias("failures"))
    return g.select(F.unix_seconds("window.start").alias("start_s"), "attempts", "failures")


def sessions(log: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    """Attempts per key in runs without a pause of gap."""
    g = log.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("attempts"))
    return g.select(key, F.unix_seconds("session_window.start").alias("start_s"), "attempts")
