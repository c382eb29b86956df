"""Queries of servers, routing policies and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health, routing, stats
from .catalogue import query
from .result_queries import LOG, _log

WINDOW, THRESHOLD, MAX_ACTIVE = 3, 0.9, 8
BY = ["snap", "start"]


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.server_stats(_log(spark, sf), F.col("srv"), F.col("ok"), F.col("cost"), F.count("*") % 13)


STATS = LOG + """, st AS (SELECT srv::BIGINT AS server, count(*) FILTER (WHERE ok)::BIGINT AS success, count(*) FILTER (WHERE NOT ok)::BIGINT AS error, sum(cost)::DOUBLE AS inflight_cost, (count(*) % 13)::BIGINT AS active FROM e GROUP BY srv),
sr AS (SELECT *, success::DOUBLE / (success + error) AS rate, greatest(active, trunc(inflight_cost)::BIGINT) AS base FROM st)
"""


@query(STATS + """SELECT server, success, error, active, round(inflight_cost, 2) AS inflight_cost, round(rate, 6) AS success_rate,
  (CASE WHEN rate < 1 THEN floor(base * (1.0::DOUBLE / greatest(rate, 0.1::DOUBLE))) ELSE base END)::BIGINT AS effective_load FROM sr""")
def q_server_stats(spark, sf):
    return _stats(spark, sf).withColumn("success_rate", F.round("success_rate", 6)).withColumn("inflight_cost", F.round("inflight_cost", 2))


@query(STATS + "SELECT round(avg(rate), 6) AS mean_success_rate, count(*)::BIGINT AS reliable_servers FROM sr WHERE success + error >= 500")
def q_cluster_avg_rate(spark, sf):
    return stats.mean_success_rate(_stats(spark, sf), 500).withColumn("mean_success_rate", F.round("mean_success_rate", 6))


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Servers as they stood in each hour of the log."""
    log = _log(spark, sf).select("*", F.date_format("ts", "yyyy-MM-dd HH").alias("snap"), F.hour("ts").alias("start"))
    n = F.count("*")
    return log.groupBy("snap", "start", F.col("srv").alias("server")).agg(
        F.sum(F.col("ok").cast("bigint")).alias("success"), F.sum((~F.col("ok")).cast("bigint")).alias("error"),
        (n % 13).alias("active"), F.sum("cost").cast("double").alias("inflight_cost"), (n % 7 != 0).alias("healthy"),
    ).withColumn("pos", F.col("server"))


#: s: snapshots; h: healthy servers (all where none is); k: with rates and places.
SNAP = LOG + """, s AS (SELECT strftime(ts, '%Y-%m-%d %H') AS snap, hour(ts)::BIGINT AS start, srv::BIGINT AS server, count(*) FILTER (WHERE ok)::BIGINT AS success, count(*) FILTER (WHERE NOT ok)::BIGINT AS error,
  (count(*) % 13)::BIGINT AS active, sum(cost)::DOUBLE AS inflight_cost, count(*) % 7 <> 0 AS healthy FROM e GROUP BY 1, 2, 3),
h AS (SELECT * FROM (SELECT *, max(healthy::INT) OVER (PARTITION BY snap) AS up FROM s) WHERE healthy OR up = 0),
r AS (SELECT *, success + error AS n, success::DOUBLE / (success + error) AS rate, greatest(active, trunc(inflight_cost)::BIGINT) AS base FROM h),
q AS (SELECT *, CASE WHEN rate < 1 THEN floor(base * (1.0::DOUBLE / greatest(rate, 0.1::DOUBLE)))::BIGINT ELSE base END AS load,
  CASE WHEN inflight_cost > 0 THEN inflight_cost ELSE active::DOUBLE END * CASE WHEN n >= 3 THEN 1.0::DOUBLE / greatest(rate, 0.1::DOUBLE) ELSE 1.0 END AS score,
  avg(CASE WHEN n >= 3 THEN rate END) OVER (PARTITION BY snap) AS mean FROM r),
u AS (SELECT *, coalesce(n >= 3 AND rate < 0.9 AND rate < mean * 0.8 - 1e-12, FALSE) AS under FROM q),
f AS (SELECT *, row_number() OVER (PARTITION BY snap ORDER BY server) - 1 AS k, count(*) OVER (PARTITION BY snap) AS size, min(under::INT) OVER (PARTITION BY snap) AS all_under FROM u),
k AS (SELECT *, (k - start % size + size) % size AS far FROM f)
"""
_OUT = "SELECT snap, start, server, active::BIGINT AS active, load::BIGINT AS effective_load, round(score, 6) AS cost_score FROM ({}) WHERE rn = 1"


def _decide(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    p = routing.Policy(strategy, allow_fallback=True, threshold=THRESHOLD, window=WINDOW, max_active=MAX_ACTIVE)
    df = routing.candidates(_snapshots(spark, sf), BY, p.allow_fallback)
    return routing.route(df, BY, p, "start").withColumn("cost_score", F.round("cost_score", 6))


@query(STATS + """SELECT server, coalesce(success + error >= 3 AND rate < 0.99 AND rate < m * 0.8 - 1e-12, FALSE) AS under FROM sr, (SELECT avg(rate) AS m FROM sr WHERE success + error >= 3)""")
def q_underperforming(spark, sf):
    s = _stats(spark, sf)
    mean = stats.mean_success_rate(s, 3)
    p = routing.Policy(threshold=0.99, window=3)
    return s.join(F.broadcast(mean)).select("server", routing.underperforming(F.col("success") + F.col("error"), F.col("success_rate"), F.col("mean_success_rate"), p).alias("under"))


@query(SNAP + "SELECT snap, start, server, under FROM u")
def q_underperforming_snapshots(spark, sf):
    from pyspark.sql import Window as W

    df = routing.candidates(_snapshots(spark, sf), BY, True)
    n, rate = F.col("success") + F.col("error"), routing.success_rate(F.col("success"), F.col("error"))
    df = df.withColumn("mean", F.avg(F.when(n >= WINDOW, rate)).over(W.partitionBy(*BY)))
    return df.select("snap", "start", "server", routing.underperforming(n, rate, F.col("mean"), routing.Policy(threshold=THRESHOLD, window=WINDOW)).alias("under"))


@query(SNAP + "SELECT snap, start, server, load::BIGINT AS effective_load FROM q")
def q_effective_load(spark, sf):
    df = routing.candidates(_snapshots(spark, sf), BY, True)
    rate = routing.success_rate(F.col("success"), F.col("error"))
    return df.select("snap", "start", "server", routing.effective_load(F.col("active"), F.col("inflight_cost"), rate).alias("effective_load"))


@query(SNAP + "SELECT snap, start, server, round(score, 6) AS cost_score FROM q")
def q_cost_score(spark, sf):
    df = routing.candidates(_snapshots(spark, sf), BY, True)
    n, rate = F.col("success") + F.col("error"), routing.success_rate(F.col("success"), F.col("error"))
    return df.select("snap", "start", "server", F.round(routing.cost_score(F.col("active"), F.col("inflight_cost"), n, rate, WINDOW), 6).alias("cost_score"))


@query(SNAP + "SELECT snap, start, server, active < 8 AND inflight_cost < 900 AS admitted FROM s")
def q_admission(spark, sf):
    p = routing.Policy(max_active=8, max_cost=900.0)
    return _snapshots(spark, sf).select("snap", "start", "server", routing.admissible(F.col("active"), F.col("inflight_cost"), p).alias("admitted"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 8)::BIGINT AS server FROM documents")
def q_rr_assign(spark, sf):
    from ..operators import chunks
    from .catalogue import table

    i = chunks.with_index(table(spark, sf, "documents").select("doc_id"), F.floor(F.col("doc_id") / 1_000_000), ["doc_id"])
    return i.select("doc_id", F.pmod("idx", F.lit(8)).alias("server"))


@query(SNAP + _OUT.format("SELECT *, row_number() OVER (PARTITION BY snap ORDER BY far) AS rn FROM k"))
def q_round_robin(spark, sf):
    return _decide(spark, sf, "round_robin")


@query(SNAP + _OUT.format("""SELECT *, row_number() OVER (PARTITION BY snap ORDER BY load, active, (k2 - start % size2 + size2) % size2) AS rn
FROM (SELECT *, row_number() OVER (PARTITION BY snap ORDER BY server) - 1 AS k2, count(*) OVER (PARTITION BY snap) AS size2 FROM k WHERE NOT under OR all_under = 1)"""))
def q_least_connections(spark, sf):
    return _decide(spark, sf, "least_connections")


@query(SNAP + _OUT.format("""SELECT *, row_number() OVER (PARTITION BY snap ORDER BY bad, CASE WHEN bad THEN active ELSE 0 END, CASE WHEN bad THEN k ELSE far END) AS rn
FROM (SELECT *, active >= 8 OR under AS bad FROM k)"""))
def q_adaptive_rr(spark, sf):
    return _decide(spark, sf, "adaptive_round_robin")


@query(SNAP + """, b AS (SELECT *, active >= 8 OR under OR active > greatest(min(active) OVER w + 1, ceil((sum(active) OVER w + 1) / size::DOUBLE)) AS bad FROM k WINDOW w AS (PARTITION BY snap)),
o AS (SELECT *, min(bad::INT) OVER (PARTITION BY snap) AS none FROM b),
good AS (SELECT *, row_number() OVER (PARTITION BY snap ORDER BY far) AS rn FROM o WHERE none = 0 AND NOT bad),
rest AS (SELECT *, row_number() OVER (PARTITION BY snap ORDER BY load, active, (k2 - start % size2 + size2) % size2) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY snap ORDER BY server) - 1 AS k2, count(*) OVER (PARTITION BY snap) AS size2 FROM o WHERE none = 1 AND (NOT under OR all_under = 1)))
""" + _OUT.format("SELECT snap, start, server, active, load, score, rn FROM good UNION ALL SELECT snap, start, server, active, load, score, rn FROM rest"))
def q_load_aware_rr(spark, sf):
    return _decide(spark, sf, "load_aware_round_robin")


_P2C = LOG + """, s AS (SELECT strftime(ts, '%Y-%m-%d %H') AS snap, hour(ts)::BIGINT AS start, srv::BIGINT AS server, count(*) FILTER (WHERE ok)::BIGINT AS success, count(*) FILTER (WHERE NOT ok)::BIGINT AS error,
  (count(*) % 13)::BIGINT AS active, sum(cost)::DOUBLE AS inflight_cost FROM e GROUP BY 1, 2, 3),
d AS (SELECT *, success + error AS n, success::DOUBLE / (success + error) AS rate, greatest(active, trunc(inflight_cost)::BIGINT) AS base FROM s WHERE server = (start * 31) % 8 OR server = (start * 31 + 17) % 8),
a AS (SELECT * FROM (SELECT *, max((active < 8)::INT) OVER (PARTITION BY snap) AS fits FROM d) WHERE active < 8 OR fits = 0),
m AS (SELECT *, avg(CASE WHEN n >= 3 THEN rate END) OVER (PARTITION BY snap) AS mean FROM a),
u AS (SELECT *, coalesce(n >= 3 AND rate < 0.9 AND rate < mean * 0.8 - 1e-12, FALSE) AS under FROM m),
v AS (SELECT *, min(under::INT) OVER (PARTITION BY snap) AS all_under,
  CASE WHEN rate < 1 THEN floor(base * (1.0::DOUBLE / greatest(rate, 0.1::DOUBLE)))::BIGINT ELSE base END AS load,
  CASE WHEN inflight_cost > 0 THEN inflight_cost ELSE active::DOUBLE END * CASE WHEN n >= 3 THEN 1.0::DOUBLE / greatest(rate, 0.1::DOUBLE) ELSE 1.0 END AS score FROM u)
"""


@query(_P2C + _OUT.format("SELECT *, row_number() OVER (PARTITION BY snap ORDER BY score, active, server) AS rn FROM v WHERE NOT under OR all_under = 1"))
def q_p2c(spark, sf):
    """Power of two choices; the sample comes from a formula that SQL has too."""
    s = _snapshots(spark, sf).withColumn("sampled", (F.col("server") == F.col("start") * 31 % 8) | (F.col("server") == (F.col("start") * 31 + 17) % 8))
    p = routing.Policy("p2c_cost_aware", threshold=THRESHOLD, window=WINDOW, max_active=MAX_ACTIVE)
    return routing.route(s, BY, p, sampled="sampled").withColumn("cost_score", F.round("cost_score", 6))


_HASHED = _P2C.replace("FROM s WHERE server = (start * 31) % 8 OR server = (start * 31 + 17) % 8", """FROM (SELECT *, row_number() OVER (PARTITION BY snap ORDER BY md5('0:' || snap || ':' || start || ':' || server), server) AS draw
  FROM (SELECT *, max(healthy::INT) OVER (PARTITION BY snap) AS up FROM (SELECT *, (success + error) % 7 <> 0 AS healthy FROM s)) WHERE healthy OR up = 0) WHERE draw <= 2""")


@query(_HASHED + _OUT.format("SELECT *, row_number() OVER (PARTITION BY snap ORDER BY score, active, server) AS rn FROM v WHERE NOT under OR all_under = 1"))
def q_p2c_hashed(spark, sf):
    """Power of two choices with the seeded sample; tests hold it against the live router's rule."""
    s = routing.hash_sample(routing.candidates(_snapshots(spark, sf), BY, True), BY, 2)
    p = routing.Policy("p2c_cost_aware", threshold=THRESHOLD, window=WINDOW, max_active=MAX_ACTIVE)
    return routing.route(s, BY, p, sampled="sampled").withColumn("cost_score", F.round("cost_score", 6))


@query(SNAP + _OUT.format("SELECT *, row_number() OVER (PARTITION BY snap ORDER BY md5('random:' || snap || ':' || start || ':' || server), server) AS rn FROM k"))
def q_random(spark, sf):
    return _decide(spark, sf, "random")


@query(SNAP + """, x AS (SELECT *, (error > 1)::INT AS out FROM h), y AS (SELECT *, min(out) OVER (PARTITION BY snap) AS all_out FROM x)
SELECT snap, start, server FROM y WHERE out = 0 OR all_out = 1""")
def q_candidate_exclusion(spark, sf):
    s = _snapshots(spark, sf)
    return routing.candidates(s, BY, True, s.where("error > 1").select(*BY, "server")).select(*BY, "server")


_HEALTH = LOG + """, p AS (SELECT event_id, ts, srv, (NOT ok)::INT AS bad, sum(ok::INT) OVER (PARTITION BY srv ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),
z AS (SELECT *, sum(bad) OVER (PARTITION BY srv, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM p)
"""


@query(_HEALTH + "SELECT event_id, srv::BIGINT AS srv, streak::BIGINT AS streak, streak < 2 AS healthy FROM z")
def q_health_state(spark, sf):
    return health.health_states(_log(spark, sf), "srv", ["ts", "event_id"], F.col("ok"), 2, F.date_trunc("hour", "ts")).select("event_id", "srv", "streak", "healthy")


@query(_HEALTH + """, t AS (SELECT *, streak < 2 AS healthy, lag(streak < 2, 1, TRUE) OVER (PARTITION BY srv ORDER BY ts, event_id) AS before FROM z)
SELECT event_id, srv::BIGINT AS srv, healthy FROM t WHERE healthy <> before""")
def q_health_transitions(spark, sf):
    states = health.health_states(_log(spark, sf), "srv", ["ts", "event_id"], F.col("ok"), 2, F.date_trunc("hour", "ts"))
    return health.transitions(states).select("event_id", "srv", "healthy")
