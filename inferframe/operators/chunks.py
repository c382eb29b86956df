"""Static sharding: a global row index without a single-partition sort, and the predicates on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_index(df: DataFrame, group: Column, order: list[str], name: str = "idx") -> DataFrame:
    """Add a 0-based index in the order of (group, order).

    group cuts the order into runs of bounded size (a file, a range of ids). Rows are numbered within their group, and
    only one row for each group enters the running sum of sizes, so no task ever holds more than a group.
    """
    g = df.withColumn("_group", group)
    sizes = g.groupBy("_group").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_group").alias("_g"), (F.sum("_n").over(W.orderBy("_group")) - F.col("_n")).alias("_before"))
    numbered = g.withColumn("_at", F.row_number().over(W.partitionBy("_group").orderBy(*order)) - 1)
    return numbered.join(before, F.col("_group") == F.col("_g")).withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint")).drop("_group", "_g", "_before", "_at")


def running_total(df: DataFrame, key: str, group: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of value over the rows of the same key before each row (0 at the first), in the order of (group, order).

    As in with_index, group cuts a key's rows into runs of bounded size, and only one row for each run enters the sums over all of them.
    """
    g = df.withColumn("_value", value).withColumn("_group", group)
    sums = g.groupBy(F.col(key).alias("_k"), F.col("_group").alias("_g")).agg(F.sum("_value").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy("_k").orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = F.coalesce(F.sum("_value").over(W.partitionBy(key, "_group").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = g.withColumn("_own", own).join(before, F.col(key).eqNullSafe(F.col("_k")) & F.col("_group").eqNullSafe(F.col("_g")))
    return out.withColumn(name, F.col("_before") + F.col("_own")).drop("_value", "_group", "_k", "_g", "_before", "_own")


def with_line_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """Index of physical lines over all files in path order, from each row's line_num: no sort, one row for each file in the running sum.

    Every chunk of a file's lines belongs to exactly one shard, whatever the shard keeps of earlier files. Rows of one line share its index.
    """
    sizes = df.groupBy("source_file").agg(F.max("line_num").alias("_n"))
    before = sizes.select(F.col("source_file").alias("_f"), (F.sum("_n").over(W.orderBy("source_file")) - F.col("_n")).alias("_before"))
    return df.join(before, F.col("source_file") == F.col("_f")).withColumn(name, F.col("_before") + F.col("line_num") - 1).drop("_f", "_before")


def checked(num_chunks: int, chunk_index: int) -> None:
    if num_chunks < 1:
        raise ValueError(f"num_chunks must be at least 1, not {num_chunks}")
    if not 0 <= chunk_index < num_chunks:
        raise ValueError(f"chunk_index must be in 0..{num_chunks - 1}, not {chunk_index}")


def in_chunk(idx: Column, num_chunks: int, chunk_index: int) -> Column:
    """Every num_chunks-th row, from chunk_index on."""
    checked(num_chunks, chunk_index)
    return F.pmod(idx, F.lit(num_chunks)) == chunk_index


def in_slice(idx: Column, total: Column, num_chunks: int, chunk_index: int) -> Column:
    """The chunk_index-th of num_chunks runs of equal length; the last may be shorter."""
    checked(num_chunks, chunk_index)
    size = F.ceil(total / num_chunks)
    return (idx >= size * chunk_index) & (idx < F.least(size * (chunk_index + 1), total))


def chunk_rows(total: Column, num_chunks: Column, chunk_index: Column) -> Column:
    """How many of total rows the modulo chunk holds."""
    return (F.floor(total / num_chunks) + F.when(chunk_index < F.pmod(total, num_chunks), 1).otherwise(0)).cast("bigint")


def chunk_path(path: str, num_chunks: int, chunk_index: int) -> str:
    """Output path of a chunk: _chunk_i before the suffix, the path itself if there is one chunk."""
    checked(num_chunks, chunk_index)
    if num_chunks == 1:
        return path
    folder, slash, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    name = f"{stem}_chunk_{chunk_index}.{suffix}" if dot and stem else f"{name}_chunk_{chunk_index}"
    return folder + slash + name


def chunk_path_column(path: Column, chunk_index: Column) -> Column:
    """chunk_path for columns, of several chunks."""
    name = F.concat(F.lit("_chunk_"), chunk_index.cast("string"))
    return F.when(path.rlike(r"[^/]\.[^./]*$"), F.concat(F.regexp_extract(path, r"^(.*[^/])(\.[^./]*)$", 1), name, F.regexp_extract(path, r"(\.[^./]*)$", 1))).otherwise(F.concat(path, name))
