"""Images of requests as data URIs: each distinct file is read once and joined back."""

from __future__ import annotations

import base64
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images


def encoded(requests: DataFrame, base: str | None = None, workers: int = 4) -> DataFrame:
    """Requests whose local images stand in their messages as data URIs.

    Paths are resolved against base, or against each row's source_dir. A file that can't be read or has no known suffix, and any
    web URL, stays as it was. Distinct paths are read by the executors with Arrow's file systems; the join on the path can be split by
    Spark where one image is in very many requests. A task reads workers files at once.
    """
    folder = F.lit(base) if base is not None else F.coalesce(F.col("source_dir"), F.lit(""))
    each = requests.where(F.size("images") > 0).select("request_id", "source_file", "line_num", "item_idx", F.posexplode("images").alias("pos", "image"), folder.alias("folder"))
    each = each.withColumn("path", images.resolved("image", F.col("folder")))
    files = each.where(~images.is_remote(F.col("path")) & images.is_supported("path")).select("path", images.media_type("path").alias("media")).distinct()
    uris = files.repartition("path").mapInArrow(lambda batches: _read(batches, workers), "path string, uri string").withColumnRenamed("path", "p")
    key = ["request_id", "source_file", "line_num", "item_idx"]
    done = each.join(uris, F.col("path") == F.col("p"), "left").withColumn("url", F.coalesce("uri", "image"))
    urls = done.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("urls"))
    urls = urls.select(*[F.col(k).alias(f"_{k}") for k in key], "urls")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    out = requests.join(urls, on, "left")
    parts = images.content_parts("prompt", F.col("urls"))
    last = F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("content"), parts.alias("parts"))
    swapped = F.transform("messages", lambda m: F.when(F.exists(m["parts"], lambda p: p["type"] == "image_url"), last).otherwise(m))
    return out.withColumn("messages", F.when(F.col("urls").isNotNull(), swapped).otherwise(F.col("messages"))).select(*requests.columns)


def _uri(path: str, media: str) -> str | None:
    from pyarrow import fs

    try:
        store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        with store.open_input_file(at) as f:
            return f"data:{media};base64,{base64.b64encode(f.read()).decode()}"
    except (OSError, pa.ArrowInvalid):
        return None


def _read(batches, workers: int):
    with ThreadPoolExecutor(max(1, workers)) as pool:
        for b in batches:
            for lo in range(0, b.num_rows, 64):  # few images are in memory at a time
                part = b.slice(lo, 64)
                out = list(pool.map(_uri, part.column(0).to_pylist(), part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["path", "uri"])
