"""Queries over the driver's tables, one or more for each operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_queries() -> dict[str, Query]:
    from . import io_queries, pipeline_queries, request_queries, result_queries, routing_queries, stream_queries  # noqa: F401

    return dict(_queries)


def all_sql() -> dict[str, str]:
    all_queries()
    return dict(_sql)
