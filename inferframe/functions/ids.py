"""Request ids."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, file_name


def canonical_id(raw: str, prompt_field: str, id_field: str, hidden: tuple[str, ...] = ()) -> str | None:
    """SHA-256 of an item's canonical JSON (sorted keys, ASCII escapes); null where raw isn't a JSON object.

    The prompt stands for itself, the other fields under data; the id field and fields that a source added are left out.
    """
    try:
        item = json.loads(raw)
    except (TypeError, ValueError):
        return None
    if not isinstance(item, dict):
        return None
    rest = {k: v for k, v in item.items() if k not in (prompt_field, "id", id_field, *hidden)}
    return hashlib.sha256(json.dumps({"prompt": item.get(prompt_field, ""), "data": rest}, sort_keys=True).encode()).hexdigest()


def content_hash(raw: str | Column, prompt_field: str = "prompt", id_field: str = "id") -> Column:
    """canonical_id of raw JSON. Byte parity with Python's JSON needs Python: an Arrow-batched function, for rows without an id only."""

    @F.pandas_udf("string")
    def run(raws: pd.Series) -> pd.Series:
        return raws.map(lambda r: None if r is None else canonical_id(r, prompt_field, id_field))

    return run(col(raw))


def column_hash(*cs: str | Column, by: str = "|") -> Column:
    """SHA-256 of columns as text: a content id that never leaves the JVM. Nulls count as empty."""
    return F.sha2(F.concat_ws(by, *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cs]), 256)


def positional_id(source: str | Column, line_num: str | Column, item_idx: Column | None = None) -> Column:
    base = F.concat(col(source), F.lit(":"), col(line_num).cast("string"))
    return base if item_idx is None else F.concat(base, F.lit("_"), item_idx.cast("string"))


def composite_id(*cs: str | Column) -> Column:
    return F.concat_ws("_", *[col(c).cast("string") for c in cs])


def file_id(source: str | Column, ident: str | Column) -> Column:
    return F.concat_ws(":", file_name(source), col(ident).cast("string"))


def bitmap_path(source: str | Column, item_idx: Column) -> Column:
    """Where the completion bitmap of a source file and item index lies: two hex digits, then the whole digest."""
    h = F.sha1(col(source).cast("binary"))
    return F.concat(F.substring(h, 1, 2), F.lit("/"), h, F.lit("_idx"), item_idx.cast("string"), F.lit(".bitmap"))
