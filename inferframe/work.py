"""The folder that the driver and all executors share, for what the engine writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir. Where that is unset, local mode takes a temporary folder; a cluster has none that all share."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that the driver and all executors share")
        base = _local.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="inferframe-"))
    return f"{base.rstrip('/')}/inferframe-{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
