import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import jobs, quota
from tidemark.operators import leases as ls
from tidemark.plans.ordered import previous_row, row_rank, running_sum
from tidemark.functions.times import as_utc, time_bucket, whole_seconds

T0 = datetime.datetime(2024, 3, 10, 1, 0, 0)


def at(n):
    return T0 + datetime.timedelta(seconds=n)


def ntz(n):
    return F.lit(at(n)).cast("timestamp_ntz")


def leases(spark, *rows):
    """(id, device, owner, fraction, start, duration)"""
    full = [(i, d, o, f, at(s), n, at(s + n)) for i, d, o, f, s, n in rows]
    return spark.createDataFrame(
        full,
        "lease_id bigint, device_id bigint, owner string, fraction_pm int, start_ts timestamp_ntz, "
        "duration_s bigint, end_ts timestamp_ntz",
    )


def test_windows_cut_in_buckets_equal_plain_windows(spark):
    """A hot key over many buckets, against a plain Python pass."""
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), i, at(rng.randint(0, 400_000)), rng.randint(-9, 9)) for i in range(800)]
    df = spark.createDataFrame(rows, "k int, id int, ts timestamp_ntz, v int").repartition(9)
    order = [F.col("ts"), F.col("id")]
    sums = running_sum(df, ["k"], time_bucket("ts"), order, {"s": F.col("v").cast("bigint")})
    down = running_sum(df, ["k"], time_bucket("ts"), [F.desc("ts"), F.desc("id")], {"d": F.col("v").cast("bigint")}, True)
    rank = row_rank(df, ["k"], time_bucket("ts", "DAY"), order, "n")
    prev = previous_row(df, ["k"], time_bucket("ts"), ["ts", "id"], {"p": F.col("v")})
    got_s, got_d = {r["id"]: r["s"] for r in sums.collect()}, {r["id"]: r["d"] for r in down.collect()}
    got_n, got_p = {r["id"]: r["n"] for r in rank.collect()}, {r["id"]: r["p"] for r in prev.collect()}
    for key in range(6):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        total, before = 0, None
        for n, (_, i, _, v) in enumerate(mine, 1):
            total += v
            assert (got_s[i], got_n[i], got_p[i]) == (total, n, before)
            before = v
        whole = sum(r[3] for r in mine)
        for _, i, _, v in mine:
            assert got_d[i] == whole - got_s[i] + v


def test_times_know_no_zone(spark):
    """The hour skipped in New York on that night counts like any other."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(at(0), at(7200))], "a timestamp_ntz, b timestamp_ntz")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            row = df.select(
                whole_seconds("a", "b").alias("s"),
                (time_bucket("b") - time_bucket("a")).alias("h"),
                F.unix_seconds(as_utc("b")).alias("u"),
            ).first()
            assert (row["s"], row["h"], row["u"]) == (7200, 2, 1710039600)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_lease_rules(spark):
    devices = spark.createDataFrame([(0, "d", 1000)], "device_id int, name string, total_bytes bigint")
    df = leases(spark, (1, -1, "a", 500, 0, 5), (2, 0, "a", 0, 0, 5), (3, 0, "a", 1500, 0, 5), (4, 0, "a", 1000, 0, 0), (5, 0, "a", 1000, 0, 5))
    got = {r["lease_id"]: r["reason"] for r in ls.validate_leases(df, devices).collect()}
    assert got == {1: "device", 2: "fraction", 3: "fraction", 4: "duration", 5: None}


def test_active_from_start_up_to_the_end(spark):
    df = leases(spark, (1, 0, "a", 500, 10, 5))
    for t, active, left in [(9, 0, 0), (10, 1, 5), (14, 1, 1), (15, 0, 0)]:
        assert ls.active_leases(df, ntz(t)).count() == active
        assert ls.time_remaining(df, ntz(t)).first()["remaining_s"] == left
    assert ls.expirations(df, ntz(15)).count() == 1 and ls.expirations(df, ntz(14)).count() == 0


def test_ends_come_before_starts(spark):
    devices = spark.createDataFrame([(0, "d", 1000), (1, "idle", 1000)], "device_id int, name string, total_bytes bigint")
    df = leases(spark, (1, 0, "a", 600, 0, 10), (2, 0, "b", 600, 10, 10), (3, 0, "b", 500, 15, 1))
    rows = ls.capacity_timeline(df, devices).orderBy("at", "delta_pm").collect()
    assert [r["used_pm"] for r in rows] == [600, 0, 600, 1100, 600, 0]
    assert [r["lease_id"] for r in ls.overcommit_audit(df).collect()] == [3]
    stats = {r["device_id"]: r for r in ls.availability_band(ls.device_stats(df, devices, ntz(15))).collect()}
    assert stats[0]["usage_pct"] == 110.0 and stats[0]["band"] == "red" and stats[0]["active_leases"] == 2
    assert stats[1]["available_bytes"] == 1000 and stats[1]["band"] == "green"
    cap = jobs.concurrency_cap(df.select("device_id", "lease_id", "start_ts", "end_ts"), "device_id", 1).first()
    assert (cap["max_active"], cap["breaches"]) == (2, 1)


@pytest.mark.parametrize("pct, band", [(70.0, "green"), (69.9, "yellow"), (30.0, "yellow"), (29.9, "red")])
def test_bands(spark, pct, band):
    df = spark.createDataFrame([(100.0 - pct,)], "usage_pct double")
    row = ls.availability_band(df.withColumn("usage_pct", F.round("usage_pct", 1))).first()
    assert row["band"] == band


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_conflicts_against_all_pairs(spark, ranges):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), f"u{rng.randint(0, 2)}", 50 * rng.randint(1, 2), rng.randint(0, 90_000), rng.randint(-5, 9000)) for i in range(150)]
    rows += [(900, 9, "x", 50, 0, 10), (901, 9, "y", 50, 10, 10)]  # touching
    df = leases(spark, *rows).repartition(5)
    want = {}
    for i, d, o, f, s, n in rows:
        for j, d2, o2, f2, s2, n2 in rows:
            if n > 0 and n2 > 0 and (d, f) == (d2, f2) and (s, i) < (s2, j) and s2 < s + n:
                want.setdefault(j, []).append((i, o != o2))
    got = {r["lease_id"]: r for r in ls.lock_conflicts(df, ranges).collect()}
    assert set(got) == set(want)
    for j, held in want.items():
        others = sum(x for _, x in held)
        assert (got[j]["held_by_other"], got[j]["held_by_same"]) == (others, len(held) - others)
        assert got[j]["kind"] == ("denied" if others else "exists")
    listed = {(r["held_id"], r["lease_id"]) for r in ls.lock_conflict_pairs(df).collect()}
    assert listed == {(i, j) for j, held in want.items() for i, _ in held}
    assert ls.lock_conflict_pairs(df).count() == len(listed)


def test_release(spark):
    df = leases(spark, (1, 0, "a", 500, 0, 10))
    ask = spark.createDataFrame([(1, "a", at(5)), (1, "root", at(5)), (1, "a", at(10)), (2, "a", at(5))], "lease_id bigint, requester string, at timestamp_ntz")
    got = sorted((r["lease_id"], r["requester"], r["verdict"]) for r in ls.release_authorization(ask, df).collect())
    assert got == [(1, "a", "not_found"), (1, "a", "released"), (1, "root", "denied"), (2, "a", "not_found")]


OPS = "event_id bigint, key bigint, ts timestamp_ntz, limit_bytes bigint, op string, buffer_id bigint, size bigint"


def ops(spark, *rows, limit=100):
    return spark.createDataFrame([(i, k, at(i * 600), lim if lim is not None else None, op, b, s) for i, (k, op, b, s, lim) in enumerate((*r, limit)[:5] if len(r) == 4 else r for r in rows)], OPS)


def test_quota_edges(spark):
    df = ops(
        spark,
        (1, "track", 1, 60), (1, "track", 2, 40), (1, "track", 3, 1), (1, "release", 3, 0), (1, "release", 2, 0),
        (1, "release", 2, 0), (1, "track", 3, 40), (2, "track", 4, 5, None), (2, "release", None, 0, None),
    )
    for ranges in (1, 7):
        got = [(r["ok"], r["usage"]) for r in quota.quota_fold(df, ranges=ranges).orderBy("event_id").collect()]
        assert got == [(True, 60), (True, 100), (False, 100), (False, 100), (True, 60), (False, 60), (True, 100), (False, 0), (False, 0)]


@pytest.mark.parametrize("limit", [40, 200, 100_000])
def test_quota_in_parallel_equals_in_order(spark, limit):
    rng = random.Random(limit)
    rows, next_id = [], 0
    for _ in range(600):
        key = 0 if rng.random() < 0.5 else rng.randint(1, 4)
        if rng.random() < 0.55:
            next_id += 1
            rows.append((key, "track", next_id if rng.random() < 0.98 else 1, rng.randint(1, 30)))
        else:
            rows.append((key, "release", rng.choice([None, rng.randint(1, next_id + 1)]), 0))
    df = ops(spark, *rows, limit=limit).repartition(6)
    got = [(r["ok"], r["usage"]) for r in quota.quota_fold(df).orderBy("event_id").collect()]
    ledgers = defaultdict(quota.Ledger)
    want = [(ledgers[k].apply(op, b, size, limit), ledgers[k].usage) for k, op, b, size in rows]
    assert got == want


@pytest.mark.parametrize("lived, rounds", [(8, 1), (400, 2), (400, 30)])
def test_quota_of_full_keys_by_blocks(spark, lived, rounds):
    """One key holds most rows and is at its limit from early on; null is a key too."""
    rng = random.Random(lived)
    rows = []
    for i in range(900):
        key = None if i % 9 == 0 else 1
        if rng.random() < 0.5 and i > lived:
            rows.append((key, "release", rng.randint(i - lived, i), 0))
        else:
            rows.append((key, "track", i if rng.random() < 0.97 else None, rng.randint(1, 30)))
    df = ops(spark, *rows, limit=60).repartition(5)
    folded = quota.quota_fold(df, block_rows=60, rounds=rounds)
    got = [(r["ok"], r["usage"]) for r in folded.orderBy("event_id").collect()]
    ledgers = defaultdict(quota.Ledger)
    want = [(ledgers[k].apply(op, b, size, 60), ledgers[k].usage) for k, op, b, size in rows]
    assert got == want and {ok for ok, _ in got} == {True, False}


def test_quota_blocks_settle_where_buffers_live_shortly(spark):
    rows = [(1, *(("track", i // 2, 40) if i % 2 == 0 else ("release", i // 2, 0))) for i in range(600)]
    rows[100:100] = [(1, "track", -1, 50), (1, "track", -2, 50), (1, "release", -1, 0), (1, "release", -2, 0)]
    df = ops(spark, *rows, limit=60).withColumn("__block", (F.col("event_id") / 50).cast("int"))
    seams = quota._seams(df, "key", ("ts", "event_id"), 3).orderBy("__block").collect()
    assert [r["__block"] for r in seams] == [r["__with"] for r in seams] == list(range(13))


def events(spark, *rows):
    return spark.createDataFrame([(i, j, at(t), s) for i, (j, t, s) in enumerate(rows)], "event_id bigint, job_id bigint, ts timestamp_ntz, status string")


def test_job_records(spark):
    df = events(spark, (1, 0, "pending"), (1, 5, "running"), (1, 5, "paused"), (1, 9, "running"), (1, 20, "timeout"), (1, 30, "failed"), (2, 1, "paused"), (3, 2, "pending"), (3, 3, "cancelled"))
    now = {r["job_id"]: r["status"] for r in jobs.current_status(df).collect()}
    assert now == {1: "failed", 2: "paused", 3: "cancelled"}
    assert jobs.active_jobs(df).first()[0] == 0 and jobs.active_jobs(df, ntz(2)).first()[0] == 2
    line = {r["job_id"]: r for r in jobs.job_timeline(df).collect()}[1]
    assert (line["wait_s"], line["run_s"], line["total_s"], line["final_status"]) == (5, 15, 20, "timeout")
    assert [r["event_id"] for r in jobs.illegal_transitions(df).collect()] == [6]


def test_duplicates_count_only_after_an_accepted_row(spark):
    rows = [(0, 1, 2.0, 5), (1, 1, 0.5, 0), (2, 1, 0.0, 5), (3, 1, 9.0, 5), (4, 2, 1.0, 1), (5, 3, None, 1)]
    df = spark.createDataFrame([(e, at(e), j, g, d) for e, j, g, d in rows], "event_id bigint, ts timestamp_ntz, job_id bigint, gpu_memory double, duration bigint")
    got = {r["event_id"]: r["reason"] for r in jobs.validate_submissions(df).collect()}
    assert got == {0: "gpu_memory", 1: "duration", 2: None, 3: "duplicate", 4: None, 5: "gpu_memory"}


def test_assign_ids(spark):
    df = leases(spark, (5, 0, "a", 1, 9, 1), (6, 0, "a", 1, 4000, 1), (7, 1, "a", 1, 0, 1))
    got = {r["lease_id"]: r["partition_id"] for r in ls.assign_ids(df).collect()}
    assert got == {5: "partition_0001", 6: "partition_0002", 7: "partition_0001"}
