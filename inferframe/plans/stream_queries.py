"""Streams over the events table, run to their end; their rows equal those of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import health, windows
from ..work import exists, new_path
from .catalogue import query, table
from .result_queries import LOG


def _events(spark: SparkSession, sf: str, trigger_files: int = 1) -> DataFrame:
    """The table as a stream: its part files, or the one file that it is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf}/events.parquet")
    r = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", trigger_files)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return r.parquet(f"{sf}/events.parquet")
    return r.option("pathGlobFilter", "events.parquet").parquet(sf)


def finished(out: DataFrame, mode: str) -> DataFrame:
    """What a stream has written once it has read all that is there: files below the shared folder. In complete mode each micro-batch replaces them."""
    spark, path = out.sparkSession, new_path(out.sparkSession, "stream")

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={batch_id}")

    q = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    rows = spark.read.schema(out.schema).parquet(f"{path}/rows") if exists(spark, f"{path}/rows") else spark.createDataFrame([], out.schema)
    return rows.select(*out.columns)


@query(LOG + "SELECT (floor(epoch(ts))::BIGINT // 3600) * 3600 AS start_s, count(*)::BIGINT AS attempts, count(*) FILTER (WHERE NOT ok)::BIGINT AS failures FROM e GROUP BY 1")
def q_stream_tumbling(spark, sf):
    log = windows.with_time(_events(spark, sf))
    return finished(windows.tumbling(log, "1 hour", F.col("event_type") != "error"), "complete")


@query("""
WITH o AS (SELECT user_id, ts, event_id, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*)::BIGINT AS attempts FROM s GROUP BY user_id, run""")
def q_stream_sessions(spark, sf):
    log = windows.with_time(_events(spark, sf))
    return finished(windows.sessions(log, "user_id", "30 minutes"), "complete")


@query(LOG + """, p AS (SELECT event_id, srv, (NOT ok)::INT AS bad, sum(ok::INT) OVER (PARTITION BY srv ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),
z AS (SELECT *, sum(bad) OVER (PARTITION BY srv, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) < 2 AS healthy FROM p),
t AS (SELECT *, lag(healthy, 1, TRUE) OVER (PARTITION BY srv ORDER BY event_id) AS before FROM z)
SELECT srv::BIGINT AS server, event_id AS seq, healthy FROM t WHERE healthy <> before""")
def q_stream_health(spark, sf):
    e = _events(spark, sf).select((F.col("user_id") % 8).alias("server"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return finished(health.health_stream(e, 2), "append")
