"""Queries of the result side: responses, projections, statistics, progress, writer batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost, response
from ..operators import chunks, project, retry, stats
from .catalogue import query, table


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """Model responses as JSON text: the turns of a conversation are the choices, their roles the finish reasons."""
    c = table(spark, sf, "conversations")
    choice = F.struct(F.col("turn").alias("index"), F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"), F.col("role").alias("finish_reason"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", choice.alias("c")))).alias("cs"), F.sum(F.length("text")).alias("chars"))
    use = F.struct((F.col("chars") % 50).alias("prompt_tokens"), F.lit(7).alias("completion_tokens"), (F.col("chars") % 50 + 7).alias("total_tokens"))
    out = F.to_json(F.struct(F.transform("cs", lambda x: x["c"]).alias("choices"), use.alias("usage")))
    return g.select(F.col("conv_id").cast("string").alias("request_id"), out.alias("model_output"), F.lit(None).cast("string").alias("additional_data"), F.when(F.col("conv_id") % 10 == 0, "timeout").alias("error"))


_RESULTS = """
WITH r AS (SELECT conv_id::VARCHAR AS request_id, conv_id, arg_min(text, turn) AS content, string_agg(coalesce(text, 'null'), '|' ORDER BY turn) AS contents, arg_min(role, turn) AS finish_reason,
  string_agg(role, '|' ORDER BY turn) AS finish_reasons, count(*)::BIGINT AS num_choices, (sum(length(text)) % 50 + 7)::BIGINT AS total_tokens, CASE WHEN conv_id % 10 = 0 THEN 'timeout' END AS error
  FROM conversations GROUP BY conv_id) """


@query(_RESULTS + "SELECT request_id, content, contents, finish_reason, finish_reasons, total_tokens, error FROM r")
def q_minimal_projection(spark, sf):
    m = project.minimal(_responses(spark, sf))
    text = F.array_join(F.transform("contents", lambda c: F.coalesce(c, F.lit("null"))), "|")
    return m.select("request_id", "content", text.alias("contents"), "finish_reason", F.array_join("finish_reasons", "|").alias("finish_reasons"), F.col("usage.total_tokens").alias("total_tokens"), "error")


@query("""
WITH c AS (SELECT conv_id, string_agg('{"index":' || turn || ',"message":{"role":"assistant"' || CASE WHEN text IS NULL THEN '' ELSE ',"content":' || to_json(text) END || '},"finish_reason":' || to_json(role) || '}', ',' ORDER BY turn) AS cs,
  sum(length(text)) % 50 AS used FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS request_id, '{"choices":[' || cs || '],"usage":{"prompt_tokens":' || used || ',"completion_tokens":7,"total_tokens":' || (used + 7) || '}}' AS model_output,
  '{"conv":' || conv_id || '}' AS additional_data, CASE WHEN conv_id % 10 = 0 THEN 'timeout' END AS error FROM c""")
def q_full_projection(spark, sf):
    """Every column of the full projection, the model's output as it came."""
    r = _responses(spark, sf).withColumn("additional_data", F.to_json(F.struct(F.col("request_id").cast("bigint").alias("conv"))))
    return project.full(r, timestamp=False)


@query(_RESULTS + "SELECT request_id, TRUE AS iso, TRUE AS recent FROM r")
def q_result_timestamp(spark, sf):
    """The timestamp of results: ISO form, and the query's time."""
    f = project.full(_responses(spark, sf))
    stamp = F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return f.select("request_id", F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$").alias("iso"), (F.abs(F.unix_seconds(F.current_timestamp()) - F.unix_seconds(stamp)) < 60).alias("recent"))


@query(_RESULTS + "SELECT request_id, finish_reason FROM r")
def q_output_fields(spark, sf):
    return project.only(project.minimal(_responses(spark, sf)), ["request_id", "finish_reason", "missing"])


@query(_RESULTS + "SELECT request_id, coalesce(content, '') AS content, num_choices, finish_reason, total_tokens FROM r")
def q_csv_row(spark, sf):
    return project.csv_rows(_responses(spark, sf)).select("request_id", "content", F.col("num_choices").cast("bigint").alias("num_choices"), "finish_reason", "total_tokens")


@query(_RESULTS + """SELECT 'Request: ' || request_id || chr(10) || CASE WHEN error IS NOT NULL THEN 'Error: ' || error
  ELSE 'Response: ' || coalesce(CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END, '') END
  || CASE WHEN num_choices > 1 THEN chr(10) || 'Choices: ' || num_choices ELSE '' END AS value FROM r""")
def q_console_lines(spark, sf):
    return project.console_lines(_responses(spark, sf))


@query("""SELECT event_id, coalesce(nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, ''), user_id::VARCHAR) AS content, 'stop' AS finish_reason,
  CASE WHEN user_id % 2 = 0 THEN json_extract_string(props, '$.k')::BIGINT ELSE 0 END AS total_tokens FROM events""")
def q_simple_response(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    tokens = F.when(F.col("user_id") % 2 == 0, F.get_json_object("props", "$.k").cast("bigint"))
    body = F.try_parse_json(F.to_json(F.struct(text.alias("text"), F.col("user_id").cast("string").alias("output"), tokens.alias("tokens_used"))))
    r = e.select("event_id", response.simple_response(body).alias("r"))
    return r.select("event_id", F.col("r.choices")[0]["content"].alias("content"), F.col("r.choices")[0]["finish_reason"].alias("finish_reason"), F.col("r.usage.total_tokens").alias("total_tokens"))


@query(_RESULTS + "SELECT request_id AS id, coalesce(content, '') AS response, total_tokens AS tokens, error IS NULL AS success FROM r")
def q_custom_shape(spark, sf):
    """A saver's own shape: id, response, tokens, success."""
    r = _responses(spark, sf)
    v = response.output("model_output")
    return r.select(F.col("request_id").alias("id"), F.coalesce(response.first(response.choices(v), "content"), F.lit("")).alias("response"), response.total_tokens(v).alias("tokens"), F.col("error").isNull().alias("success"))


@query("""
SELECT conv_id, array_to_string(CASE WHEN conv_id % 3 = 0 THEN ['a.png', 'b' || conv_id] WHEN conv_id % 3 = 1 THEN ['c.png'] END, ' ') AS input_images FROM (SELECT DISTINCT conv_id FROM conversations)""")
def q_input_images(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id").distinct()
    many = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("a.png"), F.concat(F.lit("b"), F.col("conv_id").cast("string"))))
    one = F.when(F.col("conv_id") % 3 == 1, F.lit("c.png"))
    return c.select("conv_id", F.array_join(project.input_images(many, one), " ").alias("input_images"))


# ---------------------------------------------------------------- statistics


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", cost.mock_usage(F.coalesce(F.length("text"), F.lit(0)))["total_tokens"].alias("total_tokens"))


_TOKENS = """WITH u AS (SELECT doc_id, lang, p + CASE WHEN p > 512 THEN 256 ELSE 32 END AS total_tokens FROM (SELECT doc_id, lang, greatest(1, coalesce(length(text), 0) // 4) AS p FROM documents)) """


@query(_TOKENS + "SELECT lang, sum(total_tokens)::BIGINT AS total_tokens, count(*)::BIGINT AS n FROM u GROUP BY lang")
def q_token_sum(spark, sf):
    return _usage(spark, sf).groupBy("lang").agg(F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"), F.count("*").alias("n"))


@query("""SELECT CASE WHEN c > 512 THEN 'long' ELSE 'short' END AS category, count(*)::BIGINT AS n, sum(c)::DOUBLE AS cost FROM (
  SELECT greatest(1, coalesce(length(text), 0) // 4) AS c FROM documents) GROUP BY 1""")
def q_cost_histogram(spark, sf):
    c = table(spark, sf, "documents").select(cost.dispatch_cost("text").alias("c"))
    return c.groupBy(F.when(F.col("c") > 512, "long").otherwise("short").alias("category")).agg(F.count("*").alias("n"), F.sum("c").alias("cost"))


@query(_TOKENS + """SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE doc_id % 11 <> 0)::BIGINT AS completed, count(*) FILTER (WHERE doc_id % 11 = 0)::BIGINT AS failed,
  sum(CASE WHEN doc_id % 11 = 0 THEN 3 ELSE 0 END)::BIGINT AS retried, sum(CASE WHEN doc_id % 11 <> 0 THEN total_tokens ELSE 0 END)::BIGINT AS total_tokens,
  round(count(*) FILTER (WHERE doc_id % 11 <> 0) / count(*), 6)::DOUBLE AS success_rate FROM u""")
def q_run_summary(spark, sf):
    ok = F.col("doc_id") % 11 != 0
    s = stats.run_summary(_usage(spark, sf), ok, F.when(ok, F.col("total_tokens")), F.when(ok, 0).otherwise(3))
    return s.withColumn("success_rate", F.round("success_rate", 6))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """events as a log of attempts: server, ok, and an exact cost."""
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", "user_id", (F.col("user_id") % 8).alias("srv"), (F.col("event_type") != "error").alias("ok"), F.col("value").cast("decimal(18,2)").alias("cost"))


LOG = "WITH e AS (SELECT event_id, ts, user_id, user_id % 8 AS srv, event_type <> 'error' AS ok, value::DECIMAL(18,2) AS cost FROM events)"


@query(LOG + """, b AS (SELECT strftime(ts, '%Y-%m-%d %H:%M') AS bucket, count(*) FILTER (WHERE ok)::BIGINT AS completed, count(*) FILTER (WHERE NOT ok)::BIGINT AS failed FROM e GROUP BY 1),
c AS (SELECT *, sum(completed) OVER w AS completed_so_far, sum(failed) OVER w AS failed_so_far FROM b WINDOW w AS (ORDER BY bucket))
SELECT bucket, completed, failed, completed_so_far::BIGINT AS completed_so_far, failed_so_far::BIGINT AS failed_so_far, round(completed_so_far * 100.0::DOUBLE / 5000, 6) AS percentage,
  round(completed_so_far / 5000.0::DOUBLE, 6) AS success_rate FROM c""")
def q_progress(spark, sf):
    log = _log(spark, sf)
    p = stats.progress(log, F.date_format("ts", "yyyy-MM-dd HH:mm"), F.col("ok"), ~F.col("ok"), 5000)
    return p.withColumn("percentage", F.round("percentage", 6)).withColumn("success_rate", F.round("success_rate", 6))


@query(LOG + """, b AS (SELECT strftime(ts, '%Y-%m-%d %H') AS bucket, count(*)::BIGINT AS done, count(*) FILTER (WHERE NOT ok)::BIGINT AS failed FROM e GROUP BY 1)
SELECT bucket, round(CASE WHEN done > 0 THEN (done - failed) / done ELSE 0 END, 6)::DOUBLE AS success_rate, round((1000 - done) / (done / 3600.0::DOUBLE), 6) AS eta_s FROM b""")
def q_progress_rate(spark, sf):
    b = _log(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("bucket")).agg(F.count("*").alias("done"), F.sum((~F.col("ok")).cast("bigint")).alias("failed"))
    done = F.col("done")
    return b.select("bucket", F.round(stats.progress_rate(done, F.col("failed")), 6).alias("success_rate"), F.round(stats.eta_seconds(done, F.lit(1000), done / F.lit(3600.0)), 6).alias("eta_s"))


@query("SELECT k::BIGINT AS attempt, (0.5 * pow(2, k))::DOUBLE AS wait_s, least(0.5 * pow(3, k), 20.0)::DOUBLE AS capped_s FROM range(8) r(k)")
def q_backoff_schedule(spark, sf):
    k = F.col("attempt")
    return spark.range(8).select(F.col("id").alias("attempt")).select("attempt", retry.backoff(0.5, k).alias("wait_s"), retry.backoff(0.5, k, 3.0, 20.0).alias("capped_s"))


@query(LOG + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt,
  coalesce(max(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM (SELECT event_id, ts, user_id, event_id % 4 = 0 AS ok FROM e))
SELECT user_id, count(*)::BIGINT AS attempts, (count(*) - 1)::BIGINT AS retries, max(ok::INT) = 1 AS succeeded FROM n WHERE done = 0 AND attempt <= 3 GROUP BY user_id""")
def q_retry_accounting(spark, sf):
    tries = retry.attempts(_log(spark, sf), "user_id", ["ts", "event_id"], F.col("event_id") % 4 == 0, 3)
    return retry.accounting(tries, "user_id")


@query("WITH i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents) SELECT (idx // 128)::BIGINT AS batch, count(*)::BIGINT AS n FROM i GROUP BY 1")
def q_writer_batches(spark, sf):
    i = chunks.with_index(table(spark, sf, "documents").select("doc_id"), F.floor(F.col("doc_id") / 1_000_000), ["doc_id"])
    return i.groupBy(F.floor(F.col("idx") / 128).alias("batch")).agg(F.count("*").alias("n"))


@query(LOG + """
SELECT event_id, srv::BIGINT AS srv, round(coalesce(sum(cost) OVER (PARTITION BY srv ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE, 2) AS before_cost FROM e""")
def q_inflight_cost(spark, sf):
    r = chunks.running_total(_log(spark, sf), "srv", F.date_trunc("hour", "ts"), ["ts", "event_id"], F.col("cost"), "before")
    return r.select("event_id", "srv", F.round(F.col("before").cast("double"), 2).alias("before_cost"))
