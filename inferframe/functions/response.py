"""Model responses: parsing and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CHOICES, USAGE
from .text import col, first_truthy


def output(model_output: str | Column) -> Column:
    """variant of the response text; null for what isn't JSON."""
    return F.try_parse_json(col(model_output))


def choices(v: Column) -> Column:
    """array<struct<content, finish_reason>>: choices that are objects; a message that isn't an object has null content. Null without choices."""
    listed = F.try_variant_get(v, "$.choices", "array<variant>")
    objects = F.filter(listed, lambda c: F.schema_of_variant(c).startswith("OBJECT"))
    return F.transform(objects, lambda c: F.struct(F.try_variant_get(c, "$.message.content", "string").alias("content"), F.try_variant_get(c, "$.finish_reason", "string").alias("finish_reason"))).cast(CHOICES)


def usage(v: Column) -> Column:
    """Token counts; null where the response has none."""
    return F.try_variant_get(v, "$.usage", USAGE)


def total_tokens(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$.usage.total_tokens", "bigint"), F.lit(0).cast("bigint"))


def first(cs: Column, field: str) -> Column:
    return F.try_element_at(cs, F.lit(1))[field]


def minimal(request_id: Column, cs: Column, use: Column) -> list[Column]:
    """Columns of the minimal projection; the first choice's fields are also scalars."""
    return [
        request_id.alias("request_id"), first(cs, "content").alias("content"), F.transform(cs, lambda c: c["content"]).alias("contents"),
        first(cs, "finish_reason").alias("finish_reason"), F.transform(cs, lambda c: c["finish_reason"]).alias("finish_reasons"), use.alias("usage"),
    ]


def simple_response(body: Column) -> Column:
    """A plain completion service's answer as a chat response: text, tokens used, finish reason stop."""
    text = F.coalesce(first_truthy(*[F.try_variant_get(body, f"$.{k}", "string") for k in ("text", "completion", "output")]), F.lit(""))
    tokens = F.coalesce(*[F.try_variant_get(body, f"$.{k}", "bigint") for k in ("tokens_used", "tokens")], F.lit(0).cast("bigint"))
    return F.struct(
        F.array(F.struct(text.alias("content"), F.lit("stop").alias("finish_reason"))).alias("choices"),
        F.struct(F.lit(0).cast("bigint").alias("prompt_tokens"), F.lit(0).cast("bigint").alias("completion_tokens"), tokens.alias("total_tokens")).alias("usage"),
    )
