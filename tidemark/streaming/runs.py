"""Resumable, pausable runs: a stream of files with progress saved at each batch.

Offsets and commits below ``checkpoint_dir`` say where a run stands. A batch is
written to a folder of its own id, so a batch that is replayed after a crash
replaces itself. Output, checkpoints and control live on shared storage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.control import Control
from .live import LiveProgress


class Paused(Exception):
    """Raised at a batch boundary to leave the batch for the next start."""


@dataclass(frozen=True)
class RunResult:
    status: str
    reason: str | None
    checkpoint: dict | None


def output(spark: SparkSession, run_dir: str) -> DataFrame:
    """What the run has written so far."""
    return spark.read.parquet(f"{run_dir}/data").drop("batch_id")


def progress(spark: SparkSession, run_dir: str) -> DataFrame:
    """One row per committed batch: batch_id, rows, saved_at."""
    return spark.read.parquet(f"{run_dir}/progress")


def last_checkpoint_info(spark: SparkSession, run_dir: str) -> DataFrame:
    """The latest save and the totals so far, as one row."""
    return progress(spark, run_dir).agg(
        F.max_by(F.struct("batch_id", "saved_at"), "batch_id").alias("last"),
        F.count("*").alias("batches"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_done"),
    )


def resumable_run(
    source: DataFrame,
    run_dir: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    control: Control | None = None,
) -> RunResult:
    """Runs ``source`` to its end, or to a pause; calling it again goes on from there.

    The control flag is looked at before each batch: when set, the batch is left
    untouched for the next start and all earlier ones are committed. Beside the progress saved
    with each batch, ``live`` below ``run_dir`` has what Spark reports of a batch once it is
    committed.
    """
    spark = source.sparkSession
    paused = []

    def save(batch: DataFrame, batch_id: int) -> None:
        if control is not None and control.pause_requested():
            paused.append(batch_id)
            raise Paused("pause requested")
        seen = Observation(f"batch-{batch_id}")
        rows = batch if transform is None else transform(batch)
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.write.mode("overwrite").parquet(f"{run_dir}/data/batch_id={batch_id}")
        done = spark.range(1).select(
            F.lit(seen.get["rows"]).cast("bigint").alias("rows"),
            F.current_timestamp().alias("saved_at"),
        )
        done.write.mode("overwrite").parquet(f"{run_dir}/progress/batch_id={batch_id}")

    try:
        with LiveProgress(spark, f"{run_dir}/live") as live:
            query = (
                source.writeStream.foreachBatch(save)
                .queryName(live.name)
                .option("checkpointLocation", f"{run_dir}/state")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
    except StreamingQueryException:
        if not paused:
            raise
        if control is not None:
            control.mark("paused")
        return RunResult("paused", "pause requested", _last(spark, run_dir))
    if control is not None:
        control.mark("completed")
    return RunResult("completed", None, _last(spark, run_dir))


def _last(spark: SparkSession, run_dir: str) -> dict | None:
    """A control-plane read of one row for the caller's status line."""
    try:
        return last_checkpoint_info(spark, run_dir).first().asDict(recursive=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def run_to_table(stream: DataFrame, run_dir: str, mode: str = "append") -> DataFrame:
    """Drains a stream into Parquet below ``run_dir`` and returns that table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{run_dir}/data")
        .option("checkpointLocation", f"{run_dir}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{run_dir}/data")
