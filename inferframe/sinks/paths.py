"""Output paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import file_stem


def mirrored(root: str, source_file: Column, source_dir: Column, filename: str | None = None, pattern: str = "result.jsonl", preserve: bool = True) -> Column:
    """Path under root that mirrors the source's folder. filename may hold {source}, the source's stem; else pattern names the file."""
    if filename is None:
        name = F.lit(pattern)
    else:
        before, mark, after = filename.partition("{source}")
        name = F.concat(F.lit(before), file_stem(source_file), F.lit(after)) if mark else F.lit(filename)
    folder = F.when(source_dir == "", None).otherwise(source_dir) if preserve else F.lit(None).cast("string")
    return F.concat_ws("/", F.lit(root.rstrip("/")), folder, name)
