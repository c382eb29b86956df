"""SQL form of the fan-out: SELECT ... FROM lines, LATERAL fan_out(value).

It runs a row at a time in Python, for those who write SQL only; operators.normalize.fan_out does the same in the JVM.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="item_idx int, raw string")
class FanOut:
    """Entries of a JSON list that are objects, with their places, or the one object; nothing for other values."""

    def eval(self, value: str):
        try:
            v = json.loads(value or "")
        except ValueError:
            return
        for i, x in enumerate(v if isinstance(v, list) else [v]):
            if isinstance(x, dict):
                yield i, json.dumps(x, ensure_ascii=False)


def register(spark: SparkSession, name: str = "fan_out") -> None:
    spark.udtf.register(name, FanOut)
