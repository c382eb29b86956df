"""A model that answers by rule, and data for benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost


def complete(requests: DataFrame, rollout_n: int = 1) -> DataFrame:
    """Answer every request (schema.REQUEST) with a chat response by rule, in the JVM: the model of queries and benchmarks."""
    n_images = F.greatest(F.size("images"), F.lit(0))
    said = F.concat(F.lit("mock response to "), F.col("request_id"))
    choice = F.transform(F.sequence(F.lit(0), F.lit(rollout_n - 1)), lambda i: F.struct(i.alias("index"), F.struct(F.lit("assistant").alias("role"), said.alias("content")).alias("message"), F.lit("stop").alias("finish_reason")))
    body = F.to_json(F.struct(choice.alias("choices"), cost.mock_usage(F.coalesce(F.length("prompt"), F.lit(0)), n_images).alias("usage")))
    keep = [c for c in ("additional_data", "source_file", "source_dir", "line_num", "item_idx") if c in requests.columns]
    return requests.select("request_id", body.alias("model_output"), F.lit(None).cast("string").alias("error"), *keep)


def dataset(spark: SparkSession, n: int, long_rate: float = 0.5, seed: int = 1) -> DataFrame:
    """n requests as a load test has them: short and long prompts with stated costs. Columns id, prompt, category, dispatch_cost."""
    long = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) < int(1000 * long_rate)
    words = F.when(long, 600).otherwise(12)
    return spark.range(n).select(
        F.format_string("req-%06d", "id").alias("id"), F.concat(F.lit("Question "), F.col("id").cast("string"), F.lit(": "), F.repeat(F.lit("word "), words)).alias("prompt"),
        F.when(long, "long").otherwise("short").alias("category"), F.when(long, 768).otherwise(32).alias("dispatch_cost"),
    )
