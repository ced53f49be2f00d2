"""Input views over the supplied tables, one function per view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import time_bucket
from ..session import SPREAD
from .ordered import previous_row, row_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out to as many tasks as the session asks for, if it does.

    A file of one row group is read by one task, and a local session over one file has no
    others. A cluster leaves ``SPREAD`` unset: its table has files enough and stays where
    it lies.
    """
    docs = table(spark, sf_dir, "documents")
    spread = spark.conf.get(SPREAD, None)
    return docs.repartition(int(spread)) if spread else docs


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turn (candidate) with the turn before it (reference)."""
    turns = table(spark, sf_dir, "conversations")
    cand = turns.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("cand")
    )
    ref = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref"))
    return cand.join(ref, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "conv_id", "cand", "ref"
    )


def mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("conv_id") + F.col("turn")) % 4
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"),
        F.col("text").alias("generation"),
        F.substring(F.lit("ABCD"), (at + 1).cast("int"), F.lit(1)).alias("reference"),
        F.when(at == 0, "mcq").when(at == 1, "mt").when(at == 2, "ssg").otherwise("other")
        .alias("task_type"),
    )


def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    gen = vecs.filter(F.col("vec_id") % 2 == 0).select(
        F.col("vec_id").alias("pair_id"), "label", F.col("embedding").alias("gen_vec")
    )
    ref = vecs.select((F.col("vec_id") - 1).alias("pair_id"), F.col("embedding").alias("ref_vec"))
    return gen.join(ref, "pair_id")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("embedding").alias("scores"),
        F.substring(F.lit("ABCD"), F.col("label") % 4 + 1, F.lit(1)).alias("reference"),
    )


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "embeddings")
        .filter(F.col("vec_id") < 64)
        .select(
            F.col("vec_id").cast("int").alias("token_id"),
            F.chr((F.col("vec_id") + 65).cast("int")).alias("token"),
        )
    )


def token_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = (F.col("vec_id") % 16).cast("int")
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            F.col("vec_id").alias("seq_id"),
            F.posexplode(F.slice("embedding", F.lit(1), length)).alias("pos", "x"),
        )
        .select("seq_id", "pos", (-F.abs(F.col("x").cast("double"))).alias("logprob"))
    )


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    framework = (
        F.when(kind == "click", "pytorch")
        .when(kind == "view", "tensorflow")
        .when(kind == "purchase", "sklearn")
        .when(kind == "signup", "xgboost")
        .otherwise("lightgbm")
    )
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("job_id"),
        framework.alias("framework"),
        "ts",
        F.round(F.col("value") * 100).cast("bigint").alias("bytes"),
    )
    ranked = row_rank(
        rows, ["job_id"], time_bucket("ts", "DAY"), [F.col("ts"), F.col("event_id")], "step"
    )
    return ranked.select(
        "event_id", "job_id", F.col("step").cast("int").alias("step"), "framework", "ts", "bytes"
    )


def ckpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tier copy; rows without a sidecar stand for the legacy case."""
    ext = (
        F.when(F.col("framework") == "pytorch", ".pt")
        .when(F.col("framework") == "tensorflow", ".weights.h5")
        .when(F.col("framework") == "sklearn", ".pkl")
        .when(F.col("framework") == "xgboost", ".json")
        .otherwise(".txt")
    )
    tiers = F.array_compact(
        F.array(
            F.when(F.col("event_id") % 2 == 0, F.lit("L1")),
            F.when(F.col("event_id") % 3 == 0, F.lit("L2")),
        )
    )
    return step_log(spark, sf_dir).select(
        "job_id",
        "step",
        "framework",
        "ts",
        "bytes",
        F.explode(tiers).alias("tier"),
        (F.col("event_id") % 5 != 0).alias("has_sidecar"),
        F.concat(F.lit("ckpt_0_"), F.col("step"), ext).alias("filename"),
    )


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """The same table read as a stream of its files.

    The path is a glob because a stream accepts a table of one file only so.
    """
    return (
        spark.readStream.schema(table(spark, sf_dir, name).schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{sf_dir}/{name}.parque[t]")
    )


def lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lease_of(table(spark, sf_dir, "events"))


def lease_of(events: DataFrame) -> DataFrame:
    duration = F.round(F.col("value") * 100).cast("bigint") - 50
    return (
        events.withColumn("duration_s", duration)
        .select(
            F.col("event_id").alias("lease_id"),
            (F.col("user_id") % 8).alias("device_id"),
            F.concat(F.lit("user"), F.col("user_id") % 20).alias("owner"),
            (50 + 50 * (F.col("event_id") % 10)).cast("int").alias("fraction_pm"),
            F.col("ts").alias("start_ts"),
            "duration_s",
            F.timestamp_add("SECOND", "duration_s", "ts").alias("end_ts"),
        )
    )


def lease_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lease(spark, sf_dir).withColumn(
        "actual_ms", F.col("duration_s") * 1000 + F.col("lease_id") % 100 - 50
    )


def device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "region")
        .filter(F.col("r_regionkey") < 4)
        .select(
            "r_regionkey",
            F.concat(F.lit("Device "), F.col("r_name")).alias("name"),
            F.explode(F.array(F.lit(0), F.lit(1))).alias("k"),
        )
        .select(
            (F.col("r_regionkey") + 4 * F.col("k")).alias("device_id"),
            "name",
            F.lit(8589934592).cast("bigint").alias("total_bytes"),
        )
    )


def job_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("job_id"),
        "ts",
        F.when(kind == "signup", "pending")
        .when(kind == "view", "running")
        .when(kind == "click", "paused")
        .when(kind == "purchase", "completed")
        .otherwise("failed")
        .alias("status"),
    )


def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submission_of(table(spark, sf_dir, "events"))


def submission_of(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "ts",
        F.expr("event_id * 9 DIV 10").alias("job_id"),
        (F.col("value") / 300).alias("gpu_memory"),
        (F.col("event_id") % 7 - 1).alias("duration"),
    )


def buffer_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("key"), "ts", "event_type", "value"
    )
    rows = previous_row(
        rows, ["key"], time_bucket("ts", "DAY"), ["ts", "event_id"], {"prev": F.col("event_id")}
    )
    release = F.col("event_type") == "purchase"
    return rows.select(
        "event_id",
        "key",
        "ts",
        F.lit(20000).cast("bigint").alias("limit_bytes"),
        F.when(release, "release").otherwise("track").alias("op"),
        F.when(release, F.col("prev")).otherwise(F.col("event_id")).alias("buffer_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("size"),
    )


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("name"),
        (F.col("user_id") % 10 + 1).alias("level"),
        F.col("value").alias("ms"),
    )


def _artifact(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    stem = F.when(F.col("doc_id") % 6 == 0, "ckpt_").otherwise("doc_")
    ext = F.when(F.col("doc_id") % 4 == 0, ".pt").otherwise(".txt")
    return (
        table(spark, sf_dir, "documents")
        .filter(F.col("doc_id") % every == 0)
        .select(
            F.col("source").alias("job_id"),
            F.concat(F.lit("out/"), stem, F.col("doc_id"), ext).alias("name"),
            F.col("text").alias("content"),
            F.col("doc_id").alias("saved_at"),
        )
    )


def artifact_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _artifact(spark, sf_dir, 2)


def artifact_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _artifact(spark, sf_dir, 3)


def lock_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [
        F.concat(F.lit("pid: "), F.col("lease_id") + 100),
        F.concat(F.lit("user: "), F.col("owner")),
        F.concat(F.lit("device: "), F.col("device_id")),
        F.concat(F.lit("fraction: "), F.col("fraction_pm")),
        F.concat(
            F.lit("partition: partition_"), F.lpad(F.col("lease_id").cast("string"), 6, "0")
        ),
        F.lit(""),
    ]
    return lease(spark, sf_dir).select("lease_id", F.concat_ws("\n", *lines).alias("text"))


def device_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("device_id") % 2 == 0, "Mock GPU").otherwise("Mock host")
    lines = [
        F.lit("Device statistics:"),
        F.concat(F.lit("Device "), F.col("device_id"), F.lit(": "), label),
        F.lit("  Memory:"),
        F.lit(""),
    ]
    return device(spark, sf_dir).select("device_id", F.concat_ws("\n", *lines).alias("text"))


def config_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(key % 2 == 0, "bucket").alias("s3_bucket"),
        F.when(key % 3 == 0, "key").alias("access_key"),
        F.when(key % 4 == 0, "secret").alias("secret_key"),
        F.col("c_acctbal").alias("cache_size_limit_gb"),
        (key - 3).alias("keep_checkpoints"),
        (key - 5).alias("checkpoint_every_steps"),
        (key - 10).alias("checkpoint_every_seconds"),
    )
