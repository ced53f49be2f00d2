"""Job records: the status log, submissions, concurrency and deletion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import whole_seconds
from ..plans.ordered import ranged_previous, ranged_sums

# States of a job, and the states that may come before each of them
# (running is a start or a resume).
ACTIVE = ["pending", "running"]
TERMINAL = ["completed", "failed", "timeout", "cancelled"]
ALLOWED_BEFORE = {
    "running": ["pending", "paused"],
    "paused": ["running"],
    "cancelled": ["pending", "running"],
    "results": ["completed"],
}


def current_status(events: DataFrame) -> DataFrame:
    """The current record of each job: its status row, with the stamps of the log.

    Fields a log may carry (``error``, ``partition_id``) keep the last value that a row
    gave them, as a later row without them does not take them back.
    """
    order = F.struct("ts", "event_id")
    fields = [c for c in ("error", "partition_id") if c in events.columns]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(order, F.col(c)))).alias(c) for c in fields]
    found = events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.min("ts").alias("created_at"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin(TERMINAL), F.col("ts"))).alias("ended_at"),
        F.max("ts").alias("updated_at"),
        *last,
    )
    return found.withColumns({c: F.col(c)[c] for c in fields})


def list_jobs(events: DataFrame, where: Column | None = None) -> DataFrame:
    """All current records, or those that satisfy ``where``."""
    jobs = current_status(events)
    return jobs if where is None else jobs.filter(where)


def active_jobs(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """How many jobs are pending or running, now or as of a time; paused is not active."""
    seen = events if as_of is None else events.filter(F.col("ts") <= as_of)
    return list_jobs(seen, F.col("status").isin(ACTIVE)).agg(F.count("*").alias("active_jobs"))


def job_timeline(events: DataFrame) -> DataFrame:
    """Created, started and completed stamps with wait, run and total seconds.

    Where the log carries ``error``, the first terminal row's is given too.
    """
    status = F.col("status")
    more = [c for c in ("error",) if c in events.columns]
    end = F.struct("ts", "event_id", "status", *more)
    firsts = events.groupBy("job_id").agg(
        F.min("ts").alias("created_at"),
        F.min(F.when(status == "running", F.col("ts"))).alias("started_at"),
        F.min(F.when(status.isin(TERMINAL), end)).alias("__end"),
    )
    stamped = firsts.select(
        "job_id",
        "created_at",
        "started_at",
        F.col("__end.ts").alias("completed_at"),
        F.col("__end.status").alias("final_status"),
        *[F.col(f"__end.{c}").alias(c) for c in more],
    )

    return (
        stamped.withColumn("wait_s", whole_seconds("created_at", "started_at"))
        .withColumn("run_s", whole_seconds("started_at", "completed_at"))
        .withColumn("total_s", whole_seconds("created_at", "completed_at"))
    )


def validate_submissions(
    submissions: DataFrame, order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    """Adds ``reason`` (null when accepted): duplicate, then memory, then duration.

    A row is a duplicate only of an earlier accepted one, so the first valid row
    of each id decides. That is one aggregate joined back: no window over an id.
    """
    memory_ok = F.col("gpu_memory").between(0.0, 1.0)
    duration_ok = F.col("duration") > 0
    order_key = F.struct(*order)
    first_valid = (
        submissions.filter(memory_ok & duration_ok)
        .groupBy("job_id")
        .agg(F.min(order_key).alias("__first"))
    )
    reason = (
        F.when(order_key > F.col("__first"), "duplicate")
        .when(~F.coalesce(memory_ok, F.lit(False)), "gpu_memory")
        .when(~F.coalesce(duration_ok, F.lit(False)), "duration")
    )
    return (
        submissions.join(first_valid, "job_id", "left").withColumn("reason", reason).drop("__first")
    )


def concurrency(
    intervals: DataFrame,
    worker: str,
    start: str = "start_ts",
    end: str = "end_ts",
    ranges: int | None = None,
) -> DataFrame:
    """Active count after every start and end; at equal times ends come before starts.

    An interval without an end stays active: it has no end edge. One without a start is
    taken to have begun before all others.
    """
    keys = [c for c in intervals.columns if c not in (start, end)]
    edges = intervals.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col(start).alias("at"), F.lit(1).alias("delta")),
                F.struct(F.col(end).alias("at"), F.lit(-1).alias("delta")),
            )
        ),
    ).filter((F.col("delta") == 1) | F.col("at").isNotNull())
    order = [F.col("at"), F.col("delta"), *[F.col(c) for c in keys if c != worker]]
    return ranged_sums(edges, [worker], order, {"active": (F.col("delta"), ())}, ranges)


def concurrency_cap(
    intervals: DataFrame,
    worker: str,
    cap: int = 5,
    start: str = "start_ts",
    end: str = "end_ts",
    ranges: int | None = None,
) -> DataFrame:
    """Per worker: the highest active count and how many starts went over the cap."""
    counted = concurrency(intervals, worker, start, end, ranges)
    return counted.groupBy(worker).agg(
        F.max("active").alias("max_active"),
        F.count_if((F.col("delta") == 1) & (F.col("active") > cap)).alias("breaches"),
    )


def illegal_transitions(
    events: DataFrame, order: Sequence[str] = ("ts", "event_id"), ranges: int | None = None
) -> DataFrame:
    """Status rows that may not follow the status before them.

    A status without a rule may follow anything; one with a rule may not come first.
    """
    by_time = [F.col(c) for c in order]
    seen = ranged_previous(events, ["job_id"], by_time, {"previous": F.col("status")}, ranges)
    bad = F.lit(False)
    for action, before in ALLOWED_BEFORE.items():
        bad = bad | (
            (F.col("status") == action)
            & ~F.coalesce(F.col("previous").isin(before), F.lit(False))
        )
    return seen.filter(bad)


def dedupe_submissions(
    submissions: DataFrame, order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    """The first row of each job id."""
    rest = [c for c in submissions.columns if c != "job_id"]
    first = submissions.groupBy("job_id").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    )
    return first.select("job_id", "__first.*").select(*submissions.columns)


def delete_jobs(doomed: DataFrame, *tables: DataFrame, key: str = "job_id") -> list[DataFrame]:
    """Each table without the rows of the doomed jobs."""
    ids = doomed.select(key).distinct()
    return [t.join(ids, key, "left_anti") for t in tables]
