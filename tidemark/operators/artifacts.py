"""Artifact catalog over two tiers, each a table (job_id, name, content, saved_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import TIER_LABELS


def base_name(name: Column | str) -> Column:
    """The last path component; directories in a name are dropped."""
    return F.regexp_replace(name, "^.*/", "")


def artifact_key(df: DataFrame) -> DataFrame:
    """Adds base_name and ``artifacts/{job}/{name}``."""
    return df.withColumn("base_name", base_name("name")).withColumn(
        "key", F.concat_ws("/", F.lit("artifacts"), F.col("job_id"), "base_name")
    )


def load_artifacts(requests: DataFrame, l1: DataFrame, l2: DataFrame) -> DataFrame:
    """Content of each requested (job_id, name): from L1, else L2, else ``not_found``.

    The winning copy is chosen on keys and save times alone. Contents are shuffled
    once, by the key of the copy, which all later steps share.
    """
    wanted = artifact_key(requests).select("job_id", "base_name").distinct()

    def copies(tier: DataFrame, label: str) -> DataFrame:
        return tier.withColumn("base_name", base_name("name")).withColumn("source", F.lit(label))

    both = copies(l1, "L1").unionByName(copies(l2, "L2"))
    in_l1 = F.when(F.col("source") == "L1", 1).otherwise(0)
    winners = (
        both.select("job_id", "base_name", "source", "saved_at")
        .join(wanted, ["job_id", "base_name"], "left_semi")
        .groupBy("job_id", "base_name")
        .agg(F.max(F.struct(in_l1.alias("in_l1"), "saved_at")).alias("best"))
        .select(
            "job_id",
            "base_name",
            F.when(F.col("best.in_l1") == 1, "L1").otherwise("L2").alias("source"),
            F.col("best.saved_at").alias("saved_at"),
        )
    )
    copy = ["job_id", "base_name", "source", "saved_at"]
    # Two saves may share a time: the greater content wins, as any fixed rule would do.
    contents = (
        both.join(winners, copy, "left_semi").groupBy(*copy).agg(F.max("content").alias("content"))
    )
    asked = artifact_key(requests).join(winners, ["job_id", "base_name"], "left")
    return asked.join(contents, copy, "left").select(
        *requests.columns,
        "source",
        "content",
        F.when(F.col("source").isNull(), "not_found").otherwise("found").alias("status"),
    )


def list_artifacts(
    l1: DataFrame, l2: DataFrame, prefix: str | None = None, newest_first: bool = True
) -> DataFrame:
    """Names of both tiers; L1 hides checkpoints. Content is never read."""

    def tier(df: DataFrame, label: str) -> DataFrame:
        return artifact_key(df.select("job_id", "name", "saved_at")).select(
            "job_id",
            F.col("base_name").alias("name"),
            F.col("key").alias("path"),
            "saved_at",
            F.lit(TIER_LABELS[label]).alias("source"),
        )

    shown = ~F.col("name").startswith("ckpt_") & ~F.col("name").endswith(".pt")
    listed = tier(l1, "L1").filter(shown).unionByName(tier(l2, "L2"))
    if prefix:
        listed = listed.filter(F.col("name").startswith(prefix))
    return listed.orderBy(F.desc("saved_at"), "job_id", "name", "source") if newest_first else listed
