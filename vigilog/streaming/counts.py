"""What a stream has taken in, batch by batch, as a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: The observed metric that :func:`analyzer.touched_values` sets on the events.
METRIC = "ingested"

COUNTS = "batch_id bigint, at timestamp, events bigint"


class IngestCounts(StreamingQueryListener):
    """Writes the number of events of each batch of one query, a folder per batch.

    Spark reports a batch after it is committed, on a thread of its own, so a batch that a restart repeats is written again
    over its own folder. Batches without new input report no metric and have no row.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.run: str | None = None
        self.last = -1
        self.ended = threading.Event()
        self.failed: Exception | None = None

    def watch(self, query: StreamingQuery) -> IngestCounts:
        """Counts the batches of ``query`` from now on, and those it still remembers."""
        self.run = str(query.runId)
        self.spark.streams.addListener(self)
        for progress in query.recentProgress:
            self._write(progress)
        if not query.isActive:
            self.ended.set()
        return self

    def _write(self, progress) -> None:
        row = progress.observedMetrics.get(METRIC)
        if row is None:
            return
        counted = self.spark.createDataFrame([(progress.batchId, progress.timestamp, row["events"])], "batch_id bigint, at string, events bigint")
        counted.selectExpr("batch_id", "cast(at AS timestamp) AS at", "events").coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/b{progress.batchId}"
        )
        self.last = max(self.last, progress.batchId)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) != self.run:
            return
        try:
            self._write(event.progress)
        except Exception as wrong:  # noqa: BLE001 - on Spark's thread; told by close()
            self.failed = wrong

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.ended.set()

    def close(self, seconds: float = 60) -> None:
        """Waits for the reports of a query that has ended, and stops listening."""
        in_time = self.ended.wait(seconds)
        self.spark.streams.removeListener(self)
        if self.failed:
            raise self.failed
        if not in_time:
            raise TimeoutError("the query has not ended")


def ingest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``(batch_id, at, events)``: what :class:`IngestCounts` has written."""
    return spark.read.schema(COUNTS).parquet(f"{folder}/b*")
