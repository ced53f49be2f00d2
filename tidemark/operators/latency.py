"""Latency reports: summary, exact percentiles, expiry error, scalability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written


def latency_summary(samples: DataFrame, by: Sequence[str] = ("name",), ms: str = "ms") -> DataFrame:
    """Mean, population deviation, min, max and count; all 0 for no samples."""

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return samples.groupBy(*by).agg(
        or_zero(F.avg(ms)).alias("mean_ms"),
        or_zero(F.stddev_pop(ms)).alias("stddev_ms"),
        or_zero(F.min(ms)).alias("min_ms"),
        or_zero(F.max(ms)).alias("max_ms"),
        F.count(ms).alias("iterations"),
    )


def latency_percentiles(
    samples: DataFrame,
    by: str = "name",
    ms: str = "ms",
    points: Sequence[float] = (0.5, 0.95, 0.99),
    approximate: bool = False,
    accuracy: int = 10000,
) -> DataFrame:
    """Percentiles per group with linear interpolation: (by, p, value).

    The exact form never holds a group. A mergeable sketch brackets each point, one
    pass counts what lies below the bracket, and only the values inside it are
    shuffled and ranked.
    """
    samples = samples.select(by, ms).filter(F.col(ms).isNotNull())
    if approximate:
        sketch = F.percentile_approx(ms, [float(p) for p in points], accuracy)
        wide = samples.groupBy(by).agg(sketch.alias("v"))
        return wide.select(by, F.posexplode("v").alias("i", "value")).select(
            by, F.get(F.array(*[F.lit(float(p)) for p in points]), F.col("i")).alias("p"), "value"
        )

    # A sketch's rank error is at most count/accuracy. Of the half-widths below a group
    # takes the narrowest that exceeds that error by two ranks, so its bracket is sure
    # to hold both neighbours of the point; the widest are the group's own extremes.
    widths = [w for w in (2.0 / accuracy, 0.001, 0.01, 0.1) if w >= 2.0 / accuracy]
    marks = sorted(
        {min(1.0, max(0.0, float(p) + side * w)) for p in points for w in widths for side in (-1, 1)}
    )
    error = F.col("n") / accuracy + 2

    def bracket(p: float) -> Column:
        low, high = F.col("lowest"), F.col("highest")
        for w in reversed(widths):
            wide = F.col("n") * w >= error
            if p - w > 0:
                low = F.when(wide, F.get("m", F.lit(marks.index(p - w)))).otherwise(low)
            if p + w < 1:
                high = F.when(wide, F.get("m", F.lit(marks.index(p + w)))).otherwise(high)
        return F.struct(F.lit(p).alias("p"), low.alias("lo"), high.alias("hi"))

    # One row per group and point. Written, so that Spark knows its size: small, it is
    # broadcast and the samples meet it where they lie; otherwise they are shuffled by group.
    brackets = written(
        samples.groupBy(by)
        .agg(
            F.percentile_approx(ms, marks, accuracy).alias("m"),
            F.min(ms).alias("lowest"),
            F.max(ms).alias("highest"),
            F.count("*").alias("n"),
        )
        .select(by, "n", F.inline(F.array(*[bracket(float(p)) for p in points])))
        .select(
            F.col(by).alias("__by"), "p", "lo", "hi", (F.col("p") * (F.col("n") - 1)).alias("at")
        ),
        "brackets",
    )
    placed = (
        samples.join(brackets, F.col(by).eqNullSafe(F.col("__by")))
        .filter(F.col(ms) <= F.col("hi"))
        .select(by, "p", "at", F.when(F.col(ms) >= F.col("lo"), F.col(ms)).alias("value"))
        .groupBy(by, "p", "at", "value")
        .agg(F.count("*").alias("c"))
    )
    # The null value carries all that lies below the bracket and sorts first.
    upto = Window.partitionBy(by, "p").orderBy(F.asc_nulls_first("value"))
    ranked = placed.withColumn("seen", F.sum("c").over(upto))
    low, high = F.floor("at"), F.ceil("at")
    holds = lambda rank: (F.col("seen") > rank) & (F.col("seen") - F.col("c") <= rank)
    return (
        ranked.groupBy(by, "p", "at")
        .agg(
            F.max(F.when(holds(low), F.col("value"))).alias("__low"),
            F.max(F.when(holds(high), F.col("value"))).alias("__high"),
        )
        .select(
            by,
            "p",
            (
                F.col("__low")
                + (F.col("at") - F.floor("at")) * (F.col("__high") - F.col("__low"))
            ).alias("value"),
        )
    )


def expiration_error(observed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary of |actual - expected| duration in milliseconds."""
    errors = observed.withColumn(
        "error_ms", F.abs(F.col("actual_ms") - F.col("duration_s") * 1000).cast("double")
    )
    return latency_summary(errors, by, "error_ms")


def scalability(
    samples: DataFrame, success: Column, by: Sequence[str] = ("name",), level: str = "level"
) -> DataFrame:
    """Total time over successes per concurrency level, summarised over the levels.

    A level without a success is left out.
    """
    levels = (
        samples.groupBy(*by, level)
        .agg(F.sum("ms").alias("__total"), F.count_if(success).alias("__good"))
        .filter(F.col("__good") > 0)
        .withColumn("__per", F.col("__total") / F.col("__good"))
    )
    return latency_summary(levels, by, "__per").withColumnRenamed("iterations", "levels")
