"""Unique job ids in a stream of submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.times import as_utc


def dedupe_stream(submissions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first row of each job id seen within the watermark; later rows than that are dropped."""
    timed = submissions.withColumn("event_time", as_utc("ts"))
    return (
        timed.withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["job_id"])
        .drop("event_time")
    )
