"""Progress of running streams, and stopping them."""

from __future__ import annotations

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the last reports (name, batch, rows, rows a second) of all streams of a session."""

    def __init__(self, keep: int = 100):
        self.reports: deque[tuple[str | None, int, int, float]] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.reports.append((p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watch(spark: SparkSession, keep: int = 100) -> Progress:
    listener = Progress(keep)
    spark.streams.addListener(listener)
    return listener


def cancel(spark: SparkSession, name: str | None = None, tag: str | None = None) -> None:
    """Stop the streams with a name (all without one) and the jobs with a tag."""
    for query in spark.streams.active:
        if name is None or query.name == name:
            query.stop()
    if tag:
        spark.interruptTag(tag)
