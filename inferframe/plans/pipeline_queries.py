"""Queries that run the pipeline end to end with the mock model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import response
from ..operators import normalize, project, resume
from ..sources import mock
from .catalogue import query, table


def _requests(spark, sf):
    """Documents as JSON lines, through the normaliser."""
    docs = table(spark, sf, "documents").where("text is not null")
    lines = docs.select(
        F.concat("source", F.lit("/conv.jsonl")).alias("source_file"), F.col("source").alias("source_dir"), (F.col("doc_id") + 1).alias("line_num"),
        F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("prompt"), "lang")).alias("value"),
    )
    return normalize.requests(normalize.fan_out(lines))


_PENDING = """
WITH u AS (SELECT doc_id, lang, greatest(1, length(text) // 4) AS p FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
v AS (SELECT *, p + CASE WHEN p > 512 THEN 256 ELSE 32 END AS total_tokens FROM u) """


@query(_PENDING + "SELECT lang, count(*)::BIGINT AS n, sum(total_tokens)::BIGINT AS total_tokens FROM v GROUP BY lang")
def q_pipeline_tokens(spark, sf):
    """Prompts to requests, those not done yet to the mock model, tokens by language."""
    done = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("request_id"))
    results = mock.complete(resume.pending_by_id(_requests(spark, sf), done))
    lang = F.get_json_object("additional_data", "$.lang")
    return results.groupBy(lang.alias("lang")).agg(F.count("*").alias("n"), F.sum(response.total_tokens(response.output("model_output"))).alias("total_tokens"))


@query(_PENDING + """SELECT doc_id::VARCHAR AS request_id, 'mock response to ' || doc_id AS content, 'stop' AS finish_reason, 2::BIGINT AS n_choices, total_tokens::BIGINT AS total_tokens FROM v""")
def q_pipeline_minimal(spark, sf):
    """The same requests with two choices each, through the minimal projection."""
    done = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("request_id"))
    m = project.minimal(mock.complete(resume.pending_by_id(_requests(spark, sf), done), 2))
    return m.select("request_id", "content", "finish_reason", F.size("contents").cast("bigint").alias("n_choices"), F.col("usage.total_tokens").alias("total_tokens"))
