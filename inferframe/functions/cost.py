"""Dispatch costs and the deterministic token model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PART
from .text import col

#: Metadata fields that state a cost, in order of precedence (fixed values).
COST_FIELDS = ("dispatch_cost", "estimated_tokens", "input_tokens", "prompt_tokens")
IMAGE_COST = 256


def length_cost(chars: Column) -> Column:
    """A token for each four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(chars / 4)).cast("bigint")


def dispatch_cost(prompt: str | Column, *stated: Column) -> Column:
    """The first stated cost above zero, else the estimate from the prompt's length; a null prompt counts as empty."""
    estimate = length_cost(F.coalesce(F.length(col(prompt)), F.lit(0))).cast("double")
    return F.coalesce(*[F.when(s.cast("double") > 0, s.cast("double")) for s in stated], estimate)


def stated_costs(item: Column, fields: tuple[str, ...] = COST_FIELDS) -> list[Column]:
    """The cost fields of a map<string, variant>, numbers and booleans only."""
    out = []
    for f in fields:
        v = F.try_element_at(item, F.lit(f))
        numeric = F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN|INT|SMALLINT|TINYINT)")
        out.append(F.when(numeric, F.try_variant_get(v, "$", "double")))
    return out


def multimodal_cost(cost: str | Column, n_images: Column) -> Column:
    return col(cost) + IMAGE_COST * F.coalesce(n_images, F.lit(0))


def message_cost(messages: str | Column) -> Column:
    """Cost of all messages together: characters of every text, and a fixed cost for each image."""
    m = col(messages)
    parts = F.flatten(F.transform(m, lambda x: F.coalesce(x["parts"], F.array().cast(f"array<{PART}>"))))
    chars = F.aggregate(F.transform(m, lambda x: F.coalesce(F.length(x["content"]), F.lit(0))), F.lit(0), lambda a, x: a + x)
    chars = chars + F.aggregate(F.transform(parts, lambda p: F.when(p["type"] == "text", F.coalesce(F.length(p["text"]), F.lit(0))).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return length_cost(chars).cast("double") + IMAGE_COST * F.size(F.filter(parts, lambda p: p["type"] == "image_url"))


def runner_cost(loader_cost: str | Column, messages: str | Column) -> Column:
    """The loader's cost, or that of the messages where it is null or zero."""
    c = col(loader_cost)
    return F.when(c > 0, c).otherwise(message_cost(messages))


def mock_usage(chars: Column, n_images: Column | None = None) -> Column:
    """Usage that the mock model reports: long prompts get long completions."""
    prompt = length_cost(chars) + (IMAGE_COST * F.coalesce(n_images, F.lit(0)) if n_images is not None else 0)
    completion = F.when(prompt > 512, F.lit(256)).otherwise(F.lit(32)).cast("bigint")
    return F.struct(prompt.cast("bigint").alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).cast("bigint").alias("total_tokens"))


def mock_latency_ms(prompt_tokens: Column, server: Column, base: float = 5.0) -> Column:
    """The mock model's delay without its random part."""
    step = F.least(F.floor(prompt_tokens / 16), F.lit(100))
    return F.lit(base) + step + F.pmod(server, F.lit(7))
