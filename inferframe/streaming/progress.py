"""Progress of streams and of batch runs as it happens."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

log = logging.getLogger(__name__)


class Progress(StreamingQueryListener):
    """Calls back at a stream's start, after each micro-batch with its number, rows and rows per second, and at the end with the
    error or None. Errors of a callback are logged, as a report must not stop the work. Add it by spark.streams.addListener."""

    def __init__(self, on_batch: Callable[[int, int, float], None], on_start: Callable[[str], None] | None = None, on_end: Callable[[str | None], None] | None = None):
        self.on_batch, self.on_start, self.on_end = on_batch, on_start, on_end

    @staticmethod
    def _tell(callback: Callable | None, *values) -> None:
        try:
            if callback is not None:
                callback(*values)
        except Exception:
            log.exception("progress callback")

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self._tell(self.on_start, str(event.id))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self._tell(self.on_batch, p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self._tell(self.on_end, event.exception)


class TaskProgress:
    """Calls back every interval seconds while its block runs: tasks done and tasks of the stages that are active. Nothing is called for an interval of 0."""

    def __init__(self, spark: SparkSession, interval: float, report: Callable[[int, int], None]):
        self.tracker, self.interval, self.report, self.stopped = spark.sparkContext.statusTracker(), interval, report, threading.Event()

    def now(self) -> tuple[int, int]:
        stages = [self.tracker.getStageInfo(i) for i in self.tracker.getActiveStageIds()]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    def _run(self) -> None:
        while not self.stopped.wait(self.interval):
            Progress._tell(lambda: self.report(*self.now()))

    def __enter__(self) -> TaskProgress:
        if self.interval > 0:
            threading.Thread(target=self._run, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.stopped.set()
