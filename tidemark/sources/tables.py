"""Sinks and their readers: artifacts, benchmark results, job outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.artifacts import base_name
from ..plans.scratch import written
from .files import remove_files

# Column titles of a result file.
RESULT_COLUMNS = {
    "name": "Test Name",
    "mean_ms": "Mean (ms)",
    "stddev_ms": "StdDev (ms)",
    "min_ms": "Min (ms)",
    "max_ms": "Max (ms)",
    "iterations": "Samples",
}
_RESULT_SCHEMA = (
    "`Test Name` string, `Mean (ms)` double, `StdDev (ms)` double, "
    "`Min (ms)` double, `Max (ms)` double, `Samples` bigint"
)


_ARTIFACT_COLUMNS = ["name", "content", "saved_at", "job_id"]


def _spread_artifacts(rows: DataFrame, spread: int) -> DataFrame:
    """By job and a hash of the name: a busy job has ``spread`` tasks, a small one few files."""
    return rows.repartition("job_id", F.pmod(F.xxhash64("name"), F.lit(spread)))


def write_artifacts(artifacts: DataFrame, path: str, spread: int = 32) -> None:
    """Appends (job_id, name, content, saved_at), one folder per job, base names only.

    Job ids are text: an id that looks like a number keeps its zeros. ``spread`` bounds the
    tasks that write one job.
    """
    rows = artifacts.select(
        F.col("job_id").cast("string").alias("job_id"),
        base_name("name").alias("name"),
        F.col("content").cast("binary").alias("content"),
        "saved_at",
    )
    _spread_artifacts(rows, spread).write.mode("append").partitionBy("job_id").parquet(path)


def read_artifacts(spark: SparkSession, path: str, saved_at: str = "bigint") -> DataFrame:
    """The current content of each (job, name): a later save replaces an earlier one.

    Of saves at the same time the greater content wins, as in ``load_artifacts``. The
    schema is given, as the folder names of jobs would be read as numbers otherwise;
    ``saved_at`` is the type the artifacts were written with.
    """
    schema = f"name string, content binary, saved_at {saved_at}, job_id string"
    rows = spark.read.schema(schema).parquet(path)
    key = ["job_id", "name"]
    newest = rows.groupBy(*key).agg(F.max("saved_at").alias("saved_at"))
    return (
        rows.join(newest, [*key, "saved_at"], "left_semi")
        .groupBy(*key, "saved_at")
        .agg(F.max("content").alias("content"))
        .select(*_ARTIFACT_COLUMNS)
    )


def compact_artifacts(
    spark: SparkSession, path: str, target: str, saved_at: str = "bigint", spread: int = 32
) -> None:
    """Writes the current contents to ``target``, replacing the partitions they touch."""
    (
        _spread_artifacts(read_artifacts(spark, path, saved_at), spread)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("job_id")
        .parquet(target)
    )


def delete_artifacts(
    spark: SparkSession, path: str, doomed: DataFrame, target: str, saved_at: str = "bigint"
) -> None:
    """Writes the artifacts of all but the ``doomed`` jobs to ``target``, a folder of its own."""
    if path.rstrip("/") == target.rstrip("/"):
        raise ValueError("target is the folder that is read; delete_rows deletes in place")
    rows = read_artifacts(spark, path, saved_at)
    ids = doomed.select(F.col("job_id").cast("string").alias("job_id")).distinct()
    (
        _spread_artifacts(rows.join(ids, "job_id", "left_anti"), 32)
        .write.mode("overwrite")
        .partitionBy("job_id")
        .parquet(target)
    )


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_by_key(
    rows: DataFrame, path: str, key: str = "job_id", parts: int = 64, spread: int = 8
) -> None:
    """Appends rows to a table in ``parts`` folders by a hash of ``key``, for ``delete_rows``.

    A folder is written by ``spread`` tasks, so that a busy key is not one task.
    """
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(spread))
    dealt = rows.withColumn("part", _part(key, parts)).repartition("part", salt)
    dealt.write.mode("append").partitionBy("part").parquet(path)


def delete_rows(
    spark: SparkSession, path: str, doomed: DataFrame, key: str = "job_id", parts: int = 64, spread: int = 8
) -> None:
    """Deletes the rows of the ``doomed`` keys from a table of ``write_by_key``, in place.

    Only folders that may hold such keys are read; each is replaced as a whole when the job
    commits (dynamic partition overwrite), and one of which nothing is left loses its files.
    All other folders keep theirs. Run again after a failure, it ends in the same state.
    Rows without a key stay.
    """
    ids = doomed.select(key).filter(F.col(key).isNotNull()).distinct()
    hit = [r["part"] for r in ids.select(_part(key, parts).alias("part")).distinct().collect()]
    touched = spark.read.parquet(path).filter(F.col("part").isin(hit))
    kept = touched.join(ids, key, "left_anti").select(*touched.columns)
    filled = {r["part"] for r in kept.select("part").distinct().collect()}
    emptied = touched.filter(~F.col("part").isin(sorted(filled)))
    old = written(emptied.select(F.col("_metadata.file_path").alias("path")).distinct(), "emptied")
    salt = F.pmod(F.xxhash64(*kept.columns), F.lit(spread))
    (
        kept.repartition("part", salt)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part")
        .parquet(path)
    )
    remove_files(old)


def read_by_key(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def split_sink(path: str, reason: str = "reason") -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function that keeps good rows and rows with a ``reason`` apart.

    A batch is one folder named by its id, written as a whole: a replayed batch replaces
    itself and leaves one copy.
    """
    kind = F.when(F.col(reason).isNull(), "good").otherwise("quarantine")

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("kind", kind)
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch_id={batch_id}")

    return save


def run_split_sink(stream: DataFrame, path: str, reason: str = "reason") -> None:
    """Drains a validated stream into ``path``; called again, it goes on where it stopped."""
    query = (
        stream.writeStream.foreachBatch(split_sink(f"{path}/data", reason))
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_split(stream: DataFrame, path: str, kind: str) -> DataFrame:
    """The ``good`` or the ``quarantine`` rows of ``run_split_sink``."""
    fields = [*stream.schema.fields, T.StructField("batch_id", T.LongType())]
    schema = T.StructType([*fields, T.StructField("kind", T.StringType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{path}/data")
    return rows.filter(F.col("kind") == kind).drop("kind", "batch_id")


def write_results_csv(results: DataFrame, path: str) -> None:
    """A header and one row per benchmark."""
    named = results.select(*[F.col(c).alias(title) for c, title in RESULT_COLUMNS.items()])
    named.write.mode("overwrite").option("header", True).csv(path)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Results by name; the sample count is not read back."""
    rows = spark.read.schema(_RESULT_SCHEMA).option("header", True).csv(path)
    return rows.select(
        *[F.col(f"`{t}`").alias(c) for c, t in RESULT_COLUMNS.items() if c != "iterations"]
    )


def write_job_outcomes(outcomes: DataFrame, path: str) -> None:
    """Results and errors of outcome rows, each below its own folder.

    One write, partitioned by kind: the functions that made the rows run once.
    """
    kind = F.when(F.col("status") == "completed", "result").otherwise("error")
    outcomes.withColumn("kind", kind).write.mode("append").partitionBy("kind").parquet(path)


def read_job_results(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of the jobs that completed."""
    rows = spark.read.parquet(path).filter(F.col("kind") == "result")
    return rows.drop("kind", "error", "traceback")


def read_job_errors(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of the jobs that failed."""
    return spark.read.parquet(path).filter(F.col("kind") == "error").drop("kind", "result")
