"""Bucketed windows against plain ones, with nulls in keys and order and with ties."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.times import time_bucket
from tidemark.operators import cadence, checkpoints, jobs, latency
from tidemark.plans.ordered import (
    group_bounds,
    previous_row,
    ranged,
    ranged_previous,
    ranged_rank,
    ranged_sums,
    row_rank,
    running_sum,
)

AT = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, key string, ts timestamp_ntz, v bigint"


def rows():
    out, number = [], 0
    for key in ("a", "b", None):
        for hours in (None, 0, 0, 1, 1, 30, 31, None, 900):
            number += 1
            ts = None if hours is None else AT + dt.timedelta(hours=hours)
            out.append((number, key, ts, number % 5 - 1 if number % 4 else None))
    return out


@pytest.fixture
def log(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def same(got, want):
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


@pytest.mark.parametrize("descending", [False, True])
def test_running_sum_and_rank(log, descending):
    order = [F.desc(c) if descending else F.asc(c) for c in ("ts", "id")]
    window = Window.partitionBy("key").orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.coalesce("v", F.lit(0))
    got = running_sum(log, ["key"], time_bucket("ts", "HOUR"), order, {"s": value}, descending)
    same(got, log.withColumn("s", F.sum(value).over(upto)))
    got = row_rank(log, ["key"], time_bucket("ts", "DAY"), order, "n", descending)
    same(got, log.withColumn("n", F.row_number().over(window).cast("bigint")))


def test_previous_row(log):
    got = previous_row(log, ["key"], time_bucket("ts", "HOUR"), ["ts", "id"], {"p": F.col("v")})
    want = log.withColumn("p", F.lag("v").over(Window.partitionBy("key").orderBy("ts", "id")))
    same(got, want)


@pytest.mark.parametrize("ranges", [1, 3, 9, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_ranged_windows(log, ranges, descending):
    """Sums over a key and over a key's parts, ranks and lags, whatever the ranges."""
    sorting = [F.desc(c) if descending else F.asc(c) for c in ("ts", "id")]
    order = [F.col("ts"), F.col("id")]
    window = Window.partitionBy("key").orderBy(*sorting)
    finer = Window.partitionBy("key", F.col("id") % 3).orderBy(*sorting)
    parts = log.withColumn("part", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    got = ranged_sums(parts, ["key"], order, {"s": (F.col("v"), ()), "f": (F.col("v"), ["part"])}, ranges, descending)
    same(got, parts.withColumn("s", F.sum("v").over(window)).withColumn("f", F.sum("v").over(finer)))
    same(
        ranged_rank(log, ["key"], order, "n", ranges, descending),
        log.withColumn("n", F.row_number().over(window).cast("bigint")),
    )
    if not descending:
        got = ranged_previous(log, ["key"], order, {"p": F.col("v"), "q": F.col("id")}, ranges)
        same(got, log.withColumn("p", F.lag("v").over(window)).withColumn("q", F.lag("id").over(window)))


def test_one_time_stamp_is_spread(spark):
    """A key whose rows all bear one time: many ranges, each a small part, rows as by the window."""
    log = spark.range(20_000).select("id", F.lit("a").alias("key"), F.lit(AT).alias("ts"), F.lit(1).alias("v"))
    order = [F.col("ts"), F.col("id")]
    sizes = [r["count"] for r in ranged(log, ["key"], order, 16).groupBy("__range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16
    got = ranged_sums(log, ["key"], order, {"s": (F.col("v"), ())}, 16)
    assert got.filter("s <> id + 1").count() == 0 and got.count() == 20_000
    got = ranged_previous(log, ["key"], order, {"p": F.col("id")}, 16)
    assert got.filter("coalesce(p, -1) <> id - 1").count() == 0


def test_ranged_windows_of_nothing(spark):
    log = spark.createDataFrame([], SCHEMA)
    order = [F.col("ts"), F.col("id")]
    assert ranged_rank(log, ["key"], order, "n").collect() == []
    assert ranged_previous(log, ["key"], order, {"p": F.col("v")}).collect() == []


def test_all_equal_times(spark):
    log = spark.createDataFrame([(i, "a", AT, 1) for i in range(50)], SCHEMA)
    got = running_sum(log, ["key"], time_bucket("ts"), [F.col("ts"), F.col("id")], {"s": F.col("v")})
    assert sorted(r["s"] for r in got.collect()) == list(range(1, 51))


def test_empty(spark):
    log = spark.createDataFrame([], SCHEMA)
    assert row_rank(log, ["key"], time_bucket("ts"), [F.col("id")], "n").collect() == []


def test_group_bounds_take_nulls_as_a_group(log):
    frame = log.select("key", "id").orderBy("key", "id").toPandas()
    assert group_bounds(frame, ["key"]) == [(0, 9), (9, 18), (18, 27)]


def test_open_intervals_stay_active(spark):
    rows = [("w", 1, AT, None), ("w", 2, AT + dt.timedelta(hours=1), None),
            ("w", 3, AT + dt.timedelta(hours=2), AT + dt.timedelta(hours=5))]
    intervals = spark.createDataFrame(
        rows, "worker string, id bigint, start_ts timestamp_ntz, end_ts timestamp_ntz"
    )
    got = jobs.concurrency_cap(intervals, "worker", cap=2).first()
    assert (got["max_active"], got["breaches"]) == (3, 1)


def test_retention_of_null_jobs(spark):
    files = [(j, t, f"ckpt_0_{i}.pt", i, AT + dt.timedelta(days=i) if i else None, 1)
             for j in (1, None) for t in ("L1", None) for i in range(4)]
    table = spark.createDataFrame(
        files, "job_id bigint, tier string, filename string, step int, ts timestamp_ntz, bytes bigint"
    )
    for keep in (2, 2000):
        got = checkpoints.retention(table, keep).collect()
        assert len(got) == len(files)
        assert all((r["action"] == "keep") == (keep > 4 or r["step"] >= 2) for r in got)


def test_nothing_vanishes_from_eviction_transitions_and_ids(spark):
    log = spark.createDataFrame(
        [(1, None, AT, "paused"), (2, None, None, "running"), (3, 7, AT, "running"), (4, 7, None, "paused")],
        "event_id bigint, job_id bigint, ts timestamp_ntz, status string",
    )
    assert {r["event_id"] for r in jobs.illegal_transitions(log).collect()} == {2, 4}
    files = spark.createDataFrame(
        [(None, "a", 1, AT, 5), (1, "b", 1, None, 5), (1, "c", 2, AT, 5)],
        "job_id bigint, filename string, step int, ts timestamp_ntz, bytes bigint",
    )
    assert checkpoints.cache_eviction(files, F.lit(AT).cast("timestamp_ntz")).count() == 3


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 4000, 60_000])
def test_percentiles_at_every_size(spark, n):
    samples = spark.range(n).select(F.lit("x").alias("name"), (F.col("id") * 7919 % n).cast("double").alias("ms"))
    samples = samples.unionByName(samples.limit(1).withColumn("name", F.lit(None).cast("string")))
    got = latency.latency_percentiles(samples).filter("name = 'x'").collect()
    assert sorted((r["p"], r["value"]) for r in got) == [
        (p, pytest.approx(p * (n - 1))) for p in (0.5, 0.95, 0.99)
    ]


def test_current_record_keeps_what_a_row_said(spark):
    log = spark.createDataFrame(
        [(1, 1, AT, "running", None, "p1"), (2, 1, AT + dt.timedelta(1), "failed", "boom", None),
         (3, 1, AT + dt.timedelta(2), "paused", None, None)],
        "event_id bigint, job_id bigint, ts timestamp_ntz, status string, error string, partition_id string",
    )
    got = jobs.current_status(log).first()
    assert (got["status"], got["error"], got["partition_id"]) == ("paused", "boom", "p1")
    assert jobs.job_timeline(log).first()["error"] == "boom"


def test_cadence_survives_nulls(spark):
    rows = [(j, i, i, AT + dt.timedelta(hours=i)) for j in (1, None) for i in range(40)]
    rows += [(1, 100, None, AT), (None, 101, 5, None), (2, 102, None, None)]
    log = spark.createDataFrame(rows, "job_id bigint, event_id bigint, step int, ts timestamp_ntz")
    got = cadence.checkpoint_cadence(log, None, 36_000, block=8).collect()
    assert len(got) == len(rows)
    for job in (1, None):
        mine = sorted(r["step"] for r in got if r["job_id"] == job and r["saved"])
        assert mine == [10, 20, 30]
