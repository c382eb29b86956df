"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Steps of all distribution functions together (8 bytes each) up to which they are broadcast; more are joined by shuffle.
BROADCAST_STEPS = 500_000
OWN = ("copy_no", "n_copies", "rate", "shuffle_key")


def _log_factorial(n):
    """ln(n!) by Stirling's series, to double precision from n = 100 on; 0 for 0."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(x * 6.283185307179586) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(n == 0, 0.0).otherwise(series)


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, seed: str = "mix-1", rounds: float = 1.0, keep: list[str] | None = None) -> DataFrame:
    """Repeat each document a Poisson number of times, so that sources meet their target weights in the mean, in random order.

    A source's rate is rounds * documents * weight / documents of the source; without weights, a source weighs its number of
    documents to the power of temperature. Given weights are normalised; a source that they lack has rate 0. The count of a
    document inverts the Poisson distribution at a uniform number taken from md5(seed:doc_id), so it doesn't depend on
    partitions or reruns. A source's distribution function has a row for each count within 12 standard deviations (and 30) of its rate;
    beyond lie less than 2^-52. Copies are exploded and then dealt over all partitions by a second hash and sorted by it.

    Returns the columns of docs and copy_no int (from 1), n_copies int, rate double and shuffle_key long, which gives the global order;
    columns of docs by these names are replaced. With keep, only these columns of docs are returned, and those by these names are docs' own.
    Null text is kept as it is; a null source is a source of its own; a null doc_id hashes as the empty string; repeated rows draw the same
    count each. An empty table gives an empty result.
    """
    names = keep if keep is not None else [c for c in docs.columns if c.lower() not in OWN]
    whole = docs.select(F.struct(*names).alias("row"), F.col("source").cast("string").alias("source"), F.col("doc_id").alias("doc_id"))
    counts = saved(docs.groupBy(F.col("source").cast("string").alias("of")).agg(F.count("*").cast("double").alias("n")), "counts")
    if weights is None:
        raw = counts.withColumn("w", F.pow("n", F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        raw = counts.join(given, F.col("of").eqNullSafe(F.col("name")), "left").select("of", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = raw.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    scale = rounds * (total["n"] or 0.0) / (total["w"] or 1.0)
    rate, far = F.col("rate"), 12 * F.sqrt("rate") + 30
    steps = raw.select("of", (F.col("w") * scale / F.col("n")).alias("rate"))
    steps = steps.withColumn("low", F.when(rate < 400, 0).otherwise(F.floor(rate - far)).cast("long")).withColumn("k", F.explode(F.sequence("low", F.ceil(rate + far).cast("long"))))
    # ln p(low), then ln p(k) - ln p(k - 1) = ln rate - ln k; sums run over one source's rows, some 24 of its standard deviations
    step = F.when(F.col("k") == F.col("low"), F.col("low") * F.log("rate") - rate - _log_factorial(F.col("low"))).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))
    run = Window.partitionBy("of").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("p", F.when(rate > 0, F.exp(F.sum(step).over(run))).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0)))
    steps = steps.withColumn("cdf", F.sum("p").over(run))
    rates = saved(steps.groupBy("of", "rate", "low").agg(F.sort_array(F.collect_list("cdf")).alias("cdf")), "rates")
    if (rates.agg(F.sum(F.size("cdf"))).first()[0] or 0) <= BROADCAST_STEPS:
        rates = F.broadcast(rates)

    def digest(*parts):
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 13), 16, 10).cast("long")

    u = digest(F.col("doc_id")) / F.lit(float(1 << 52))
    out = whole.join(rates, F.col("source").eqNullSafe(F.col("of")))
    out = out.withColumn("u", u).withColumn("n_copies", (F.col("low") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))).cast("int"))
    out = out.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    out = out.withColumn("shuffle_key", digest(F.col("doc_id"), F.col("copy_no")))
    out = out.select("row", "copy_no", "n_copies", "rate", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return out.select("row.*") if keep is not None else out.select("row.*", "copy_no", "n_copies", "rate", "shuffle_key")
