"""Server discovery from marker files named server_{ip}_{port}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = r"server_(.+)_(\d+)"


def parsed(names: DataFrame, pattern: str = PATTERN) -> DataFrame:
    """Rows whose whole name matches, with ip and port."""
    whole = f"^(?:{pattern})$"
    return names.where(F.col("name").rlike(whole)).withColumn("ip", F.regexp_extract("name", whole, 1)).withColumn("port", F.regexp_extract("name", whole, 2).cast("int"))


def discover(spark: SparkSession, servers_dir: str, pattern: str = PATTERN) -> DataFrame:
    """name, ip, port, url, healthy of the marker files in a folder, by name. A folder without any is an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(servers_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if not s.isDirectory())
    found = parsed(spark.createDataFrame([(n,) for n in names], "name string"), pattern)
    if found.isEmpty():
        raise ValueError(f"no server in {servers_dir}")
    return found.select("name", "ip", "port", F.concat(F.lit("http://"), "ip", F.lit(":"), F.col("port").cast("string")).alias("url"), F.lit(True).alias("healthy")).orderBy("name")
