"""Skipping what is done already: anti-joins by id or by position, and completion bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("source_file", "line_num", "item_idx")


def pending_by_id(requests: DataFrame, done: DataFrame, ident: str = "request_id", done_id: str = "request_id") -> DataFrame:
    """Requests whose id isn't among the completed ones. Null ids are never completed."""
    ids = done.select(F.col(done_id).alias("_done"))
    return requests.join(ids, F.col(ident) == F.col("_done"), "left_anti")


def pending_by_key(requests: DataFrame, done: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Requests whose position isn't among the completed ones."""
    d = done.select(*[F.col(k).alias(f"_d{i}") for i, k in enumerate(key)])
    on = [F.col(k) == F.col(f"_d{i}") for i, k in enumerate(key)]
    return requests.join(d, on, "left_anti")


def pending(requests: DataFrame, done: DataFrame, ident: str = "request_id", key: tuple[str, ...] = KEY, done_id: str = "request_id") -> DataFrame:
    """By position where a request has one, else by id: one pass over the requests, one join on a key that is either. Null ids are never completed."""

    def keys(name: str) -> tuple[Column, Column]:
        place = F.lit(True)
        for k in key:
            place = place & F.col(k).isNotNull()
        at = F.when(place, F.to_json(F.struct(F.lit(1).alias("kind"), *[F.col(k).cast("string").alias(k) for k in key])))
        by_id = F.when(F.col(name).isNotNull(), F.to_json(F.struct(F.lit(2).alias("kind"), F.col(name).cast("string").alias("id"))))
        return at, by_id

    at, by_id = keys(ident)
    place = F.lit(True)
    for k in key:
        place = place & F.col(k).isNotNull()
    d = done.select(F.explode(F.array(*keys(done_id))).alias("_done")).where("_done is not null")
    return requests.withColumn("_key", F.when(place, at).otherwise(by_id)).join(d, F.col("_key") == F.col("_done"), "left_anti").drop("_key")


def bitmaps(done: DataFrame, group: list[str] = ["source_file", "item_idx"], line: str = "line_num") -> DataFrame:  # noqa: B006
    """One bit for each completed line: (group, bucket, bits), 32,768 lines to a bucket, low bits first; partial bitmaps merge before the shuffle."""
    n = F.col(line)
    return done.groupBy(*group, F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))


def merged(*tables: DataFrame, group: list[str] = ["source_file", "item_idx"]) -> DataFrame:  # noqa: B006
    """Union of bitmaps of several runs."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*group, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(position, F.lit(8)))), F.lit(2)) == 1, F.lit(False))


def pending_by_bitmap(requests: DataFrame, maps: DataFrame) -> DataFrame:
    """Requests whose line has no bit; a map of 4 KiB stands for 32,768 rows, so this side stays small."""
    m = maps.select(F.col("source_file").alias("_f"), F.col("item_idx").alias("_i"), F.col("bucket").alias("_b"), "bits")
    n = F.col("line_num")
    on = (F.col("source_file") == F.col("_f")) & (F.col("item_idx") == F.col("_i")) & (F.bitmap_bucket_number(n) == F.col("_b"))
    found = requests.join(m, on, "left")
    return found.where(F.col("bits").isNull() | ~_bit(F.col("bits"), F.bitmap_bit_position(n))).select(*requests.columns)
