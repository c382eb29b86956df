"""Result projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import response
from ..functions.text import truncated


def now() -> Column:
    """The query's time in ISO form."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def full(results: DataFrame, timestamp: bool = True, carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """request_id, model_output, additional_data, with a timestamp unless told otherwise, and error; carry: further columns to keep."""
    cols = ["request_id", "model_output", "additional_data"]
    stamp = [now().alias("timestamp")] if timestamp else []
    return results.select(*cols, *stamp, "error", *carry)


def minimal(results: DataFrame, carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """First choice's content and finish reason, all choices' as arrays, usage, additional_data, error."""
    v = response.output("model_output")
    return results.select(*response.minimal(F.col("request_id"), response.choices(v), response.usage(v)), "additional_data", "error", *carry)


def only(df: DataFrame, fields: list[str] | None) -> DataFrame:
    """The columns of an allow-list, in the order of df."""
    return df if fields is None else df.select(*[c for c in df.columns if c in fields])


def csv_rows(results: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Flat columns for CSV: the usual ones, or fields (request_id and content, or a key of the response as text)."""
    v = response.output("model_output")
    cs = response.choices(v)
    if fields is None:
        contents = F.to_json(F.transform(cs, lambda c: c["content"]), {"ignoreNullFields": "false"})
        return results.select(
            "request_id", F.coalesce(response.first(cs, "content"), F.lit("")).alias("content"), F.coalesce(contents, F.lit("[]")).alias("contents"),
            F.greatest(F.size(cs), F.lit(0)).alias("num_choices"), F.coalesce(response.first(cs, "finish_reason"), F.lit("")).alias("finish_reason"), response.total_tokens(v).alias("total_tokens"),
        )

    def one(f: str) -> Column:
        if f == "request_id":
            return F.col(f)
        if f == "content":
            return F.coalesce(response.first(cs, "content"), F.lit("")).alias(f)
        x = F.try_variant_get(v, f"$.{f}", "variant")
        return F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x), F.lit("")).alias(f)

    return results.select(*[one(f) for f in fields])


def console_lines(results: DataFrame, details: bool = False, most: int = 200) -> DataFrame:
    """One text per result for a terminal."""
    v = response.output("model_output")
    cs = response.choices(v)
    n = F.greatest(F.size(cs), F.lit(0))
    said = F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error"))).otherwise(F.concat(F.lit("Response: "), F.coalesce(truncated(response.first(cs, "content"), most), F.lit(""))))
    lines = [F.concat(F.lit("Request: "), F.col("request_id")), said, F.when(n > 1, F.concat(F.lit("Choices: "), n.cast("string")))]
    if details:
        lines += [F.concat(F.lit("Tokens: "), F.try_variant_get(v, "$.usage.total_tokens", "string")), F.concat(F.lit("Additional: "), F.col("additional_data"))]
    return results.select(F.concat_ws("\n", *lines).alias("value"))


def input_images(images: Column, image: Column) -> Column:
    return F.coalesce(images, F.when(image.isNotNull(), F.array(image)))
