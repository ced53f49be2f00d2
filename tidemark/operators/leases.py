"""Lease log: validity, state at a time, capacity, conflicts, authorisation.

A lease is (lease_id, device_id, owner, fraction_pm, start_ts, duration_s, end_ts);
fractions are whole per-mille, so sums are exact. A lease is active from its start
up to but not including its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import time_bucket, whole_seconds
from ..plans.ordered import ranged_rank, ranged_sums

# Fixed value: a whole device in per-mille.
WHOLE = 1000


def validate_leases(leases: DataFrame, devices: DataFrame) -> DataFrame:
    """Adds ``reason`` (null when valid): device, then fraction, then duration."""
    known = devices.select("device_id", F.lit(True).alias("__known"))
    reason = (
        F.when(F.col("__known").isNull(), "device")
        .when(~F.coalesce(F.col("fraction_pm").between(1, WHOLE), F.lit(False)), "fraction")
        .when(~F.coalesce(F.col("duration_s") > 0, F.lit(False)), "duration")
    )
    return leases.join(known, "device_id", "left").withColumn("reason", reason).drop("__known")


def _is_active(at: Column) -> Column:
    return (F.col("start_ts") <= at) & (at < F.col("end_ts"))


def active_leases(leases: DataFrame, at: Column) -> DataFrame:
    """Leases active at a time; at its very end a lease is expired."""
    return leases.filter(_is_active(at))


def time_remaining(leases: DataFrame, at: Column) -> DataFrame:
    """Adds the whole seconds left at a time, 0 when not active."""
    elapsed = whole_seconds("start_ts", at)
    left = F.greatest(F.lit(0), F.col("duration_s") - elapsed)
    return leases.withColumn("remaining_s", F.when(_is_active(at), left).otherwise(F.lit(0)))


def expirations(leases: DataFrame, at: Column | None = None) -> DataFrame:
    """One row per expired lease, at its end; the batch form of the expiry stream."""
    valid = leases.filter(F.col("duration_s") > 0)
    done = valid if at is None else valid.filter(F.col("end_ts") <= at)
    return done.select("lease_id", "device_id", "owner", F.col("end_ts").alias("expired_at"))


def usage_edges(leases: DataFrame) -> DataFrame:
    """A +fraction row at each start and a -fraction row at each end of valid leases."""
    return leases.filter(F.col("duration_s") > 0).select(
        "device_id",
        "lease_id",
        F.inline(
            F.array(
                F.struct(F.col("start_ts").alias("at"), F.col("fraction_pm").alias("delta_pm")),
                F.struct(F.col("end_ts").alias("at"), (-F.col("fraction_pm")).alias("delta_pm")),
            )
        ),
    )


def device_usage(leases: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per-mille in use on its device after every edge; ends come before starts.

    Devices are few and a log is long, so the running sum is cut into ranges of the log.
    """
    order = [F.col("at"), F.signum("delta_pm"), F.col("lease_id")]
    return ranged_sums(
        usage_edges(leases), ["device_id"], order, {"used_pm": (F.col("delta_pm"), ())}, ranges
    )


def capacity_timeline(
    leases: DataFrame, devices: DataFrame, ranges: int | None = None
) -> DataFrame:
    """Available per-mille, bytes and percent after every start and end of a lease."""
    free = WHOLE - F.col("used_pm")
    return (
        device_usage(leases, ranges)
        .join(devices.select("device_id", "total_bytes"), "device_id")
        .select(
            "device_id",
            "lease_id",
            "at",
            "delta_pm",
            "used_pm",
            free.alias("available_pm"),
            F.expr(f"total_bytes * ({WHOLE} - used_pm) DIV {WHOLE}").alias("available_bytes"),
            (free / 10.0).alias("available_pct"),
        )
    )


def device_stats(leases: DataFrame, devices: DataFrame, at: Column) -> DataFrame:
    """Total, used and free memory and the active count per device; idle ones show 0."""
    used = (
        active_leases(leases, at)
        .groupBy("device_id")
        .agg(
            F.sum(F.col("fraction_pm").cast("bigint")).alias("__pm"),
            F.count("*").alias("__active"),
        )
    )
    pm = F.coalesce("__pm", F.lit(0))
    return (
        devices.join(used, "device_id", "left")
        .withColumn("used_pm", pm)
        .select(
            "device_id",
            "name",
            "total_bytes",
            F.expr(f"total_bytes * used_pm DIV {WHOLE}").alias("used_bytes"),
            F.expr(f"total_bytes - total_bytes * used_pm DIV {WHOLE}").alias("available_bytes"),
            (F.col("used_pm") / 10.0).alias("usage_pct"),
            F.coalesce("__active", F.lit(0)).alias("active_leases"),
        )
    )


def overcommit_audit(leases: DataFrame, ranges: int | None = None) -> DataFrame:
    """Starts after which more than the whole device was given away."""
    used = device_usage(leases, ranges)
    return used.filter((F.col("delta_pm") > 0) & (F.col("used_pm") > WHOLE))


def lock_conflicts(leases: DataFrame, ranges: int | None = None) -> DataFrame:
    """Leases that started while the same (device, fraction) was held.

    ``held_by_other`` and ``held_by_same`` count the earlier leases still active at
    the start; any other owner means ``denied``, else creation fails as ``exists``.
    Both are running sums over starts and ends, so the work grows with the log and
    not with the number of overlapping pairs.
    """
    lock = ["device_id", "fraction_pm"]
    edges = leases.filter(F.col("duration_s") > 0).select(
        *lock,
        "owner",
        "lease_id",
        F.inline(
            F.array(
                F.struct(F.col("start_ts").alias("at"), F.lit(1).alias("delta")),
                F.struct(F.col("end_ts").alias("at"), F.lit(-1).alias("delta")),
            )
        ),
    )
    held = ranged_sums(
        edges,
        lock,
        [F.col("at"), F.col("delta"), F.col("lease_id")],
        {"__all": (F.col("delta"), ()), "__own": (F.col("delta"), ["owner"])},
        ranges,
    )
    other = F.col("__all") - F.col("__own")
    return (
        held.filter((F.col("delta") == 1) & (F.col("__all") > 1))
        .select(
            "lease_id",
            *lock,
            "owner",
            F.col("at").alias("start_ts"),
            other.alias("held_by_other"),
            (F.col("__own") - 1).alias("held_by_same"),
        )
        .withColumn("kind", F.when(F.col("held_by_other") > 0, "denied").otherwise("exists"))
    )


def lock_conflict_pairs(leases: DataFrame, unit: str = "HOUR") -> DataFrame:
    """The overlapping pairs themselves, for drilling into ``lock_conflicts``.

    The earlier lease is copied to each time bucket it touches and the later one
    stands in the bucket of its start, so a pair meets exactly once and a busy
    lock is spread over its buckets. Touching leases do not conflict.
    """
    valid = leases.filter(F.col("duration_s") > 0)
    first, last = time_bucket("start_ts", unit), time_bucket("end_ts", unit)
    holders = valid.select(
        "device_id",
        "fraction_pm",
        F.explode(F.sequence(first, last)).alias("__bucket"),
        F.col("lease_id").alias("held_id"),
        F.col("owner").alias("holder"),
        F.col("start_ts").alias("__from"),
        F.col("end_ts").alias("__to"),
    )
    later = valid.select(
        "device_id", "fraction_pm", first.alias("__bucket"), "lease_id", "owner", "start_ts"
    )
    before = F.struct("__from", "held_id") < F.struct(
        F.col("start_ts").alias("__from"), F.col("lease_id").alias("held_id")
    )
    return (
        later.join(holders, ["device_id", "fraction_pm", "__bucket"])
        .filter(before & (F.col("start_ts") < F.col("__to")))
        .select(
            "held_id",
            "lease_id",
            "device_id",
            "fraction_pm",
            F.when(F.col("holder") != F.col("owner"), "denied").otherwise("exists").alias("kind"),
        )
    )


def release_authorization(requests: DataFrame, leases: DataFrame) -> DataFrame:
    """Verdict on requests (lease_id, requester, at): released, denied or not_found."""
    held = leases.select("lease_id", "owner", "start_ts", "end_ts")
    live = F.coalesce(_is_active(F.col("at")), F.lit(False))
    verdict = (
        F.when(~live, "not_found").when(F.col("owner") != F.col("requester"), "denied").otherwise("released")
    )
    return (
        requests.join(held, "lease_id", "left")
        .withColumn("verdict", verdict)
        .select(*requests.columns, "verdict")
    )


def availability_band(stats: DataFrame) -> DataFrame:
    """Adds the available percent and its band: green from 70, yellow from 30, else red."""
    pct = 100.0 - F.col("usage_pct")
    return stats.withColumn("available_pct", pct).withColumn(
        "band",
        F.when(F.col("available_pct") >= 70, "green")
        .when(F.col("available_pct") >= 30, "yellow")
        .otherwise("red"),
    )


def assign_ids(leases: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds partition_id, numbered from 1 within each device by start."""
    by_start = [F.col("start_ts"), F.col("lease_id")]
    numbered = ranged_rank(leases, ["device_id"], by_start, "number", ranges)
    return numbered.withColumn(
        "partition_id", F.format_string("partition_%04d", F.col("number"))
    )
