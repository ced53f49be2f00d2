import datetime
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import formats as fm
from tidemark.operators import cadence
from tidemark.operators import latency as lt

T0 = datetime.datetime(2024, 1, 1)
LOG = "job_id bigint, event_id bigint, step int, ts timestamp_ntz"


def log(spark, rows):
    full = [(j, i, s, T0 + datetime.timedelta(seconds=t)) for i, (j, s, t) in enumerate(rows)]
    return spark.createDataFrame(full, LOG)


def brute(rows, n, s):
    """One ordered pass per job."""
    saved, last = {}, {}
    for i, (j, step, t) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[1][1], r[1][2], r[0])):
        last.setdefault(j, t)
        save = bool((n and step > 0 and step % n == 0) or (s and t - last[j] >= s))
        saved[i] = save
        if save:
            last[j] = t
    return saved


def decided(df):
    return {r["event_id"]: r["saved"] for r in df.collect()}


@pytest.mark.parametrize("n, s", [(3, None), (None, 10), (4, 10), (4, 1), (None, 1), (1000, 25), (None, None)])
@pytest.mark.parametrize("block", [1, 5, 4096])
def test_cadence_equals_one_pass(spark, n, s, block):
    rng = random.Random(block)
    rows, t = [], 0
    for step in range(0, 160):
        t += rng.choice([0, 1, 2, 9])
        if rng.random() < 0.8:
            rows.append((0, step, t))  # a long job with gaps
    rows += [(j, step, step * j) for j in range(1, 6) for step in range(1, 8)]
    rows += [(9, step, rng.randint(0, 60)) for step in range(40)]  # a clock that jumps about
    df = log(spark, rows).repartition(5)
    assert decided(cadence.checkpoint_cadence(df, n, s, block=block)) == brute(rows, n, s)


def test_first_row_never_saves_by_time_and_a_save_resets(spark):
    rows = [(1, 1, 100), (1, 2, 109), (1, 3, 110), (1, 4, 115), (1, 5, 120)]
    got = decided(cadence.checkpoint_cadence(log(spark, rows), None, 10))
    assert got == {0: False, 1: False, 2: True, 3: False, 4: True}
    # step 3 saves by step, so step 4 is only five seconds after a save
    got = decided(cadence.checkpoint_cadence(log(spark, rows), 2, 10))
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False}


def test_cadence_as_a_tree(spark):
    """One job of many blocks, several rounds of composition, times that also go back."""
    rng = random.Random(4)
    for back in (0, 40):
        at, rows = 0, []
        for step in range(1200):
            at += rng.choice([0, 1, 1, 2, 30])
            rows.append((1, step, max(0, at - rng.randint(0, back))))
        df = log(spark, rows)
        for n, s, fan_in in ((None, 25, 2), (None, 500, 3), (None, 25, 64), (97, 60, 2)):
            got = decided(cadence.checkpoint_cadence(df, n, s, block=8, fan_in=fan_in))
            assert got == brute(rows, n, s), (back, n, s, fan_in)


def test_composed_clocks():
    rng = random.Random(2)
    for _ in range(300):
        times = np.array(sorted(rng.randint(0, 200) for _ in range(30)))
        flags = np.array([rng.random() < 0.03 for _ in times])
        wait = rng.randint(1, 60)
        parts = [cadence.clock_function(times[i : i + 10], flags[i : i + 10], wait) for i in (0, 10, 20)]
        left = cadence.composed(cadence.composed(parts[0], parts[1], 250), parts[2], 250)
        right = cadence.composed(parts[0], cadence.composed(parts[1], parts[2], 250), 250)
        for last in range(-70, 200, 7):
            want = cadence.walk(times, flags, wait, last)[1]
            assert cadence.apply_clock(left, last) == cadence.apply_clock(right, last) == want
        short = cadence.composed(parts[0], parts[1], int(times[0]))
        assert len(short) <= len(cadence.composed(parts[0], parts[1], 250))


def quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (at - low) * (values[high] - values[low])


@pytest.mark.parametrize("accuracy", [10, 50, 10_000])
def test_percentiles_are_exact_with_any_bracket(spark, accuracy):
    rng = random.Random(1)
    groups = {
        "hot": [rng.lognormvariate(0, 2) for _ in range(3000)],
        "ties": [float(rng.randint(0, 3)) for _ in range(900)],
        "few": [3.0, 1.0],
        "one": [7.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("few", None)]
    df = spark.createDataFrame(rows, "name string, ms double").repartition(7)
    points = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {(r["name"], r["p"]): r["value"] for r in lt.latency_percentiles(df, points=points, accuracy=accuracy).collect()}
    want = {(k, p): quantile(vs, p) for k, vs in groups.items() for p in points}
    assert got == pytest.approx(want)
    rough = lt.latency_percentiles(df, points=[0.5], approximate=True).collect()
    assert {r["name"] for r in rough} == set(groups)


def test_summary(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0)], "name string, ms double")
    row = lt.latency_summary(df).first()
    assert row["stddev_ms"] == pytest.approx(statistics.pstdev([1, 2, 4])) and row["iterations"] == 3
    assert tuple(lt.latency_summary(df.limit(0), by=()).first()) == (0.0, 0.0, 0.0, 0.0, 0)
    levels = spark.createDataFrame([("a", 1, 10.0), ("a", 1, 99.0), ("a", 2, 99.0), ("a", 3, 2.0)], "name string, level int, ms double")
    row = lt.scalability(levels, F.col("ms") < 50).first()
    assert (row["levels"], row["max_ms"], row["min_ms"]) == (2, 109.0, 2.0)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "n, want",
    [(0, "0.00 B"), (1023, "1023.00 B"), (1024, "1.00 KB"), (1152, "1.12 KB"), (1408, "1.38 KB"),
     (1024**5, "1.00 PB"), (1024**6, "1024.00 PB"), (5 * 1024**3 + 1, "5.00 GB")],
)
def test_format_bytes(spark, n, want):
    assert value(spark, fm.format_bytes(F.lit(n).cast("decimal(20,0)"))) == want


@pytest.mark.parametrize(
    "n, long, short",
    [(0, "0s", "0s"), (59, "59s", "59s"), (60, "1m 0s", "1m 0s"), (3600, "1h 0m 0s", "1h 0m"), (3661, "1h 1m 1s", "1h 1m"), (-20, "-20s", "-20s")],
)
def test_format_duration(spark, n, long, short):
    assert value(spark, fm.format_duration(F.lit(n))) == long
    assert value(spark, fm.format_duration(F.lit(n), "short")) == short


def test_iso(spark):
    stamp = datetime.datetime(2024, 2, 29, 23, 5, 6)
    assert value(spark, fm.parse_iso(F.lit("2024-02-29T23:05:06"))) == stamp
    for bad in ("2024-02-30T00:00:00", "2024-02-29 23:05:06", "soon", ""):
        assert value(spark, fm.parse_iso(F.lit(bad))) is None
    assert value(spark, fm.format_ts(F.lit(stamp).cast("timestamp_ntz"))) == "2024-02-29T23:05:06"
    assert value(spark, fm.format_ts(F.lit(stamp).cast("timestamp_ntz"), True)) == "2024-02-29 23:05:06"
    with pytest.raises(Exception, match="expected YYYY"):
        value(spark, fm.parse_iso(F.lit("soon"), strict=True))


def test_records_in_text(spark):
    assert value(spark, fm.extract_partition_id(F.lit("made\n  partition_0007 on gpu"))) == "partition_0007"
    assert value(spark, fm.extract_partition_id(F.lit("my_partition_1"))) is None
    text = "Device statistics:\nDevice 0: Fast GPU\n  Memory:\nDevice 11: Host"
    df = spark.createDataFrame([(text,)], "text string")
    assert [tuple(r) for r in fm.parse_device_lines(df).collect()] == [(0, "Fast GPU", "GPU"), (11, "Host", "CPU")]
    lock = spark.createDataFrame([("user: ann\nuser: bob\npid: 7\ntime: 12:00: 1\nno colon\ndevice: x\n",)], "text string")
    row = fm.parse_lock_records(lock).first()
    assert (row["owner"], row["pid"], row["device"], row["partition_id"]) == ("ann", 7, None, None)
    assert lock.select(fm.parse_lock_record("text").alias("m")).first()["m"]["time"] == "12:00: 1"


def test_rules(spark):
    schema = "s3_bucket string, access_key string, secret_key string, cache_size_limit_gb double, keep_checkpoints int, checkpoint_every_steps int, checkpoint_every_seconds int"
    df = spark.createDataFrame([(None, None, None, 1.0, 1, 1, 1), ("b", "k", None, 0.0, 1, -1, 1), ("", None, None, 1.0, 1, 1, 1)], schema)
    got = [r["errors"] for r in fm.validate_rows(df).collect()]
    assert got[0] == {} and got[2] == {}
    assert set(got[1]) == {"s3_credentials", "cache_size", "checkpoint_every_steps"}
