"""Backoff and the accounting of attempts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


T = TypeVar("T")


def call(fn: Callable[[], T], max_retries: int = 3, delay: float = 1.0, base: float = 2.0, most: float = 60.0, errors: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> T:
    """fn(), tried again after growing waits while it raises one of errors; the last error is raised on."""
    for attempt in range(max_retries + 1):
        try:
            return fn()
        except errors:
            if attempt == max_retries:
                raise
            sleep(min(delay * base**attempt, most))
    raise AssertionError


class Attempts:
    """call() as a context: for attempt in Attempts(...): with attempt: ...

    An error of the body is kept back and the body entered again after a growing wait, until it ends without one or the tries are used up; the last error goes on.
    """

    def __init__(self, max_retries: int = 3, delay: float = 1.0, base: float = 2.0, most: float = 60.0, errors: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep):
        self.max_retries, self.delay, self.base, self.most, self.errors, self.sleep = max_retries, delay, base, most, errors, sleep
        self.number, self.done = 0, False

    def __iter__(self) -> Iterator[Attempts]:
        for self.number in range(self.max_retries + 1):
            yield self
            if self.done:
                return
            self.sleep(min(self.delay * self.base**self.number, self.most))

    def __enter__(self) -> Attempts:
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self.done = kind is None
        return kind is not None and issubclass(kind, self.errors) and self.number < self.max_retries


def backoff(delay: float, attempt: Column, base: float = 2.0, most: float | None = None) -> Column:
    """Seconds to wait after the attempt (0-based)."""
    wait = F.lit(float(delay)) * F.pow(F.lit(float(base)), attempt)
    return wait if most is None else F.least(wait, F.lit(float(most)))


def attempts(log: DataFrame, request: str, order: list[str], ok: Column, max_retries: int = 3) -> DataFrame:
    """The tries that count: up to the first success, max_retries + 1 at most; adds attempt (0-based) and ok."""
    w = W.partitionBy(request).orderBy(*order)
    df = log.withColumn("ok", ok).withColumn("attempt", F.row_number().over(w) - 1)
    earlier = F.coalesce(F.max(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_done", earlier).where((F.col("_done") == 0) & (F.col("attempt") <= max_retries)).drop("_done")


def accounting(tries: DataFrame, request: str) -> DataFrame:
    """Per request: attempts, retries and whether it succeeded."""
    return tries.groupBy(request).agg(F.count("*").alias("attempts"), (F.count("*") - 1).alias("retries"), F.max(F.col("ok").cast("int")).cast("boolean").alias("succeeded"))
