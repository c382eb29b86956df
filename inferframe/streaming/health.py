"""Server health kept as state of a stream of probes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def health_stream(probes: DataFrame, max_failures: int = 5) -> DataFrame:
    """Changes of health in a stream of server long, seq long, ok boolean: server, seq, healthy.

    State per server is the current run of failures and whether it counts as healthy. Rows of one micro-batch are taken in the order of
    seq; across batches the order is that of arrival.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, healthy = state.get if state.exists else (0, True)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, ok in zip(rows["seq"], rows["ok"], strict=True):
            failures = 0 if ok else failures + 1
            now = failures < max_failures
            if now != healthy:
                out.append((key[0], seq, now))
            healthy = now
        state.update((failures, healthy))
        yield pd.DataFrame(out, columns=["server", "seq", "healthy"])

    return probes.groupBy("server").applyInPandasWithState(step, "server long, seq long, healthy boolean", "failures int, healthy boolean", "append", GroupStateTimeout.NoTimeout)
