"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space at either end, by Unicode's definition."""
    c = col(c)
    # the pattern tries every run of white space in a text, so that only texts with some at an end go through it
    edge = F.substring(c, 1, 1).rlike(r"(?U)\s") | F.substring(c, -1, 1).rlike(r"(?U)\s")
    return F.when(edge, F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def truncated(c: str | Column, most: int = 200) -> Column:
    """The first `most` characters, with an ellipsis where something was cut."""
    c = col(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def snake_case(c: str | Column) -> Column:
    """CamelCase names as snake_case, capitals in a row kept as one word."""
    words = F.regexp_replace(F.regexp_replace(col(c), r"(.)([A-Z][a-z]+)", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(words)


def first_truthy(*cs: str | Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs])


def file_name(c: str | Column) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def file_stem(c: str | Column) -> Column:
    """File name without its last suffix; a leading dot isn't a suffix."""
    return F.regexp_replace(file_name(c), r"(?<=.)\.[^.]*$", "")


def parent_dir(c: str | Column) -> Column:
    """Folder of a relative path, empty at the root."""
    return F.regexp_extract(col(c), r"^(.*)/[^/]*$", 1)


def joined(c: str | Column, by: str) -> Column:
    return F.array_join(col(c), by)
