"""Rows of a Spark query against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return bytes(x) if isinstance(x, (bytes, bytearray, memoryview)) else x


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, db: duckdb.DuckDBPyConnection) -> str:
    """Empty if the two have the same columns and rows."""
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns: {sorted(df.columns)} and {sorted(names)}"
    want, have = rows_of(names, got.fetchall()), rows_of(df.columns, df.collect())
    if want == have:
        return ""
    return f"{sum(have.values())} and {sum(want.values())} rows; only in Spark: {str(list((have - want).items())[:2])[:600]}; only in SQL: {str(list((want - have).items())[:2])[:600]}"
