"""Progress of a stream while it runs, as Spark itself reports it."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class LiveProgress(StreamingQueryListener):
    """Writes a row per finished batch of one named query, seconds after it was committed.

    A batch has a folder of its own, so one that is replayed replaces its row. ``rows`` is
    what the sources delivered. Use it as a context around a query started with ``name``;
    leaving it waits until the last row is written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self.name = f"run-{uuid.uuid4().hex}"
        self._run = None
        self._ended = threading.Event()

    def __enter__(self) -> LiveProgress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        if self._run is not None:
            self._ended.wait(60)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._run = event.runId

    def onQueryProgress(self, event) -> None:
        done = event.progress
        if done.runId != self._run or "addBatch" not in done.durationMs:
            return
        row = self.spark.range(1).select(
            F.lit(done.numInputRows).cast("bigint").alias("rows"),
            F.lit(done.durationMs["addBatch"]).cast("bigint").alias("took_ms"),
            F.lit(done.timestamp).cast("timestamp").alias("started_at"),
        )
        row.write.mode("overwrite").parquet(f"{self.path}/batch_id={done.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self._run:
            self._ended.set()


def live_progress(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, rows, took_ms, started_at) of the batches finished so far."""
    return spark.read.parquet(path)
