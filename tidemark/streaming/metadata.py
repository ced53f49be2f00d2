"""Job metadata kept over runs: what a batch adds is merged into the stored record of a job.

The table lies in folders by a hash of the job, each in numbered versions. A batch reads the
newest version before its own of the folders it touches, and writes its own; a batch that is
replayed, whole or after half of its folders were written, ends in the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checkpoints import merge_metadata, metadata_state, show_metadata
from ..plans.scratch import written
from ..sources.files import remove_files

_PLACE = [T.StructField("part", T.IntegerType()), T.StructField("version", T.LongType())]


def _newest(rows: DataFrame) -> DataFrame:
    versions = rows.groupBy("part").agg(F.max("version").alias("version"))
    return rows.join(versions, ["part", "version"], "left_semi")


def merge_job_metadata(files: DataFrame, path: str, version: int, parts: int = 64) -> None:
    """Merges the jobs in ``files`` into the table at ``path``; versions grow from call to call.

    Folders of other jobs keep their files. Of a folder that was touched the version that was
    read stays beside the new one, for readers under way; older ones are removed.
    """
    spark = files.sparkSession
    part = F.pmod(F.xxhash64("job_id"), F.lit(parts)).cast("int")
    added = written(metadata_state(files).withColumn("part", part), "added")
    schema = T.StructType([*[f for f in added.schema.fields if f.name != "part"], *_PLACE])
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("part", "version").parquet(path)
    stored = spark.read.schema(schema).parquet(path).filter(F.col("version") < version)
    hit = [r["part"] for r in added.select("part").distinct().collect()]
    stored = stored.filter(F.col("part").isin(hit))
    old = _newest(stored)
    merged = merge_metadata(old.drop("version").unionByName(added), "part")
    (
        merged.withColumn("version", F.lit(version).cast("bigint"))
        .repartition("part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part", "version")
        .parquet(path)
    )
    kept = old.select("part", "version").distinct()
    surplus = stored.withColumn("path", F.col("_metadata.file_path")).join(kept, ["part", "version"], "left_anti")
    remove_files(written(surplus.select("path").distinct(), "surplus"))


def metadata_sink(path: str, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function that merges each batch of files into the table."""

    def save(batch: DataFrame, batch_id: int) -> None:
        merge_job_metadata(batch, path, batch_id, parts)

    return save


def run_job_metadata(files: DataFrame, path: str, parts: int = 64) -> None:
    """Drains a stream of files into the table; called again, it goes on where it stopped."""
    query = (
        files.writeStream.foreachBatch(metadata_sink(f"{path}/data", parts))
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_job_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as ``job_metadata`` shows it; None if nothing was ever stored."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    return show_metadata(_newest(rows))
