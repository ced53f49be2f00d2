import datetime
import json
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import remote
from tidemark.operators import cadence, quota
from tidemark.operators import leases as ls
from tidemark.plans import queries_streams, views
from tidemark.sources import tables
from tidemark.sources.control import Control
from tidemark.streaming import dedupe, expiry, runs, stateful

SF_DIR = "/root/testdata/sf0.001"


def totals(frame):
    return pd.DataFrame({"k": [frame["k"].iloc[0]], "n": [len(frame)], "s": [frame["v"].sum()]})


def merge_totals(parts):
    return pd.DataFrame({"k": [parts["k"].iloc[0]], "n": [parts["n"].sum()], "s": [parts["s"].sum()]})


def count_stream(key, frames):
    yield pd.DataFrame({"k": [key[0]], "n": [sum(len(f) for f in frames)]})


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows have one key."""
    k = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50)
    return spark.range(20_000).select(k.alias("k"), (F.col("id") % 7).alias("v")).repartition(6)


def test_keyed_functions(spark, skewed):
    want = {r["k"]: (r["n"], r["s"]) for r in skewed.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    merged = remote.run(skewed, totals, "k bigint, n bigint, s bigint", "k", merge_totals).collect()
    assert {r["k"]: (r["n"], r["s"]) for r in merged} == want
    streamed = remote.run(skewed, count_stream, "k bigint, n bigint", "k").collect()
    assert {r["k"]: r["n"] for r in streamed} == {k: n for k, (n, _) in want.items()}


def test_merge_form_runs_where_the_rows_lie(skewed):
    plan = remote.run(skewed, totals, "k bigint, n bigint, s bigint", "k", merge_totals)
    lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
    first = lambda text: next(i for i, line in enumerate(lines) if text in line)
    assert first("FlatMapGroupsInPandas") < first("hashpartitioning") < first("MapInPandas combine")


@remote.gpu("id bigint, w bigint", factor=3)
def scaled(frame, factor, plus=0):
    """Scales."""
    return frame.assign(w=frame["id"] * factor + plus)


def test_decorator_binds_arguments(spark):
    df = spark.range(5)
    assert [r["w"] for r in scaled(df).collect()] == [0, 3, 6, 9, 12]
    assert [r["w"] for r in scaled.bind(factor=1)(df, plus=10).collect()] == [10, 11, 12, 13, 14]
    assert scaled.local(pd.DataFrame({"id": [2]}))["w"].tolist() == [6] and scaled.__doc__ == "Scales."
    big = remote.create_remote_function(lambda f, blob: f.assign(w=len(blob)), "id bigint, w bigint", blob=b"x" * (2 << 20))
    assert {r["w"] for r in big(df).collect()} == {2 << 20}


def fail_on_three(frame):
    if frame["k"].iloc[0] == 3:
        raise KeyError("three")
    return {"n": len(frame)}


def fail_on_three_in_frames(frames):
    return {"n": sum(fail_on_three(frame)["n"] for frame in frames)}


def first_frame_only(frames):
    return len(next(frames)) > 0


def join_counts(parts):
    return {"n": sum(p["n"] for p in parts)}


@pytest.mark.parametrize("merge", [None, join_counts])
def test_outcomes_are_isolated(spark, skewed, folder, merge):
    func = fail_on_three if merge else fail_on_three_in_frames
    rows = remote.capture_outcomes(skewed, func, "k", merge)
    got = {r["k"]: r for r in rows.collect()}
    assert got[3]["status"] == "failed" and got[3]["error"] == "KeyError: 'three'" and "fail_on_three" in got[3]["traceback"]
    assert got[0]["result"] == '{"n": 10000}' and got[0]["error"] is None
    assert sum(r["status"] == "failed" for r in got.values()) == 1
    tables.write_job_outcomes(rows, folder)
    assert tables.read_job_errors(spark, folder).first()["k"] == 3
    assert tables.read_job_results(spark, folder).count() == len(got) - 1


def test_outcome_of_a_key_in_many_frames(spark):
    """A key larger than a frame: one outcome row, whether its frames are read or left."""
    rows = spark.range(35_000).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.lit(1)).alias("k"), "id")
    seen = remote.capture_outcomes(rows, lambda frames: [len(f) for f in frames], "k").collect()
    sizes = {r["k"]: json.loads(r["result"]) for r in seen}
    assert sum(sizes[1]) == 30_000 and len(sizes[1]) > 1 and sum(sizes[None]) == 5_000
    left = remote.capture_outcomes(rows, first_frame_only, "k").collect()
    assert [r["status"] for r in left] == ["completed"] * 2


def test_async_handle(spark):
    done = remote.run_async(spark, lambda: spark.range(100).count())
    assert done.result(60) == 100 and done.status() == "completed" and not done.cancel()
    broken = remote.run_async(spark, lambda: 1 / 0)
    with pytest.raises(RuntimeError, match="failed"):
        broken.result(60)

    def slow_rows(frame):
        time.sleep(20)
        return frame

    slow = remote.run_async(spark, lambda: spark.range(8).mapInPandas(lambda it: map(slow_rows, it), "id bigint").count())
    with pytest.raises(TimeoutError):
        slow.result(1)
    assert slow.cancel() and slow.status() == "cancelled"
    with pytest.raises(RuntimeError, match="cancelled"):
        slow.result(60)


def staged(spark, folder, df, parts, *order):
    """The frame as ``parts`` files written one after the other in that order."""
    cut = df.withColumn("part", F.ntile(parts).over(Window.orderBy(*order))).cache()
    for part in range(1, parts + 1):
        mine = cut.filter(F.col("part") == part).drop("part")
        mine.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    cut.unpersist()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_pause_resume_equals_one_straight_run(spark, folder):
    events = views.table(spark, SF_DIR, "events")
    source = staged(spark, folder, events, 3, "event_id")
    control = Control(spark, f"{folder}/control")
    assert control.read() == (False, "running")

    def pause_after_first(batch):
        if not control.pause_requested():
            control.pause()
        return batch.select("event_id", "event_type")

    first = runs.resumable_run(source, f"{folder}/run", pause_after_first, control)
    assert first.status == "paused" and first.checkpoint["batches"] == 1
    assert runs.output(spark, f"{folder}/run").count() == first.checkpoint["rows_done"] < events.count()
    with pytest.raises(ValueError):
        control.pause()
    control.resume()
    with pytest.raises(ValueError):
        control.resume()
    second = runs.resumable_run(source, f"{folder}/run", lambda b: b.select("event_id", "event_type"), control)
    assert second.status == "completed" and second.checkpoint["batches"] == 3
    assert runs.resumable_run(source, f"{folder}/run", None, control).checkpoint["batches"] == 3
    straight = runs.resumable_run(source, f"{folder}/straight", lambda b: b.select("event_id", "event_type"))
    assert straight.checkpoint["rows_done"] == 1000
    a, b = (sorted(map(tuple, runs.output(spark, f"{folder}/{d}").collect())) for d in ("run", "straight"))
    assert a == b and len(a) == 1000


@pytest.mark.parametrize("kind", ["nulls", "one time", "empty"])
def test_staged_tables_keep_all_rows_in_batches_of_folders(spark, folder, kind, monkeypatch):
    ts = {"nulls": "CASE WHEN id % 3 > 0 THEN timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) END",
          "one time": "timestamp_ntz'2024-01-01'", "empty": "timestamp_ntz'2024-01-01'"}[kind]
    df = spark.range(0, 0 if kind == "empty" else 600, 1, 6).selectExpr("id", f"{ts} AS ts")
    monkeypatch.setattr(queries_streams, "scratch_dir", lambda spark, purpose: f"{folder}/{purpose}")
    source = queries_streams._staged(spark, df, "staged")
    files = [len(list(part.glob("*.parquet"))) for part in Path(f"{folder}/staged").iterdir()]
    assert len(files) == 4 and len(set(files)) == 1 and (kind == "empty" or files[0] > 1)
    seen = []
    runs.resumable_run(source, f"{folder}/run", lambda batch: seen.append(
        batch.agg(F.min("ts"), F.max("ts")).first()) or batch)
    last = runs.last_checkpoint_info(spark, f"{folder}/run").first()
    assert (last["batches"], last["rows_done"]) == (4, df.count())
    assert sorted(runs.output(spark, f"{folder}/run").collect(), key=lambda r: r["id"]) == df.orderBy("id").collect()
    times = [t for bounds in seen for t in bounds if t is not None]
    assert times == sorted(times)


def test_crash_inside_a_batch_is_replayed_once(spark, folder):
    events = views.table(spark, SF_DIR, "events").select("event_id")
    source = staged(spark, folder, events, 3, "event_id")
    seen = []

    def crash_on_second(batch):
        seen.append(1)
        if len(seen) == 2:
            raise OSError("lost")
        return batch

    with pytest.raises(Exception, match="lost"):
        runs.resumable_run(source, f"{folder}/run", crash_on_second)
    assert runs.resumable_run(source, f"{folder}/run").status == "completed"
    assert sorted(r[0] for r in runs.output(spark, f"{folder}/run").collect()) == sorted(r[0] for r in events.collect())


def test_expiry_stream_over_batches_and_releases(spark, folder):
    df = views.lease(spark, SF_DIR).withColumn("op", F.lit("create"))
    gone = [r["lease_id"] for r in df.filter("duration_s > 7000").limit(5).collect()]
    freed = df.filter(F.col("lease_id").isin(gone)).withColumn("op", F.lit("release"))
    freed = freed.withColumn("start_ts", F.timestamp_add("SECOND", F.lit(60), "start_ts"))
    stream = staged(spark, folder, df.unionByName(freed), 4, "start_ts")
    got = runs.run_to_table(expiry.expire_stream(stream), f"{folder}/out").collect()
    last = df.filter("duration_s > 0").agg(F.max("start_ts")).first()[0]
    want = ls.expirations(df, F.lit(last).cast("timestamp_ntz")).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want if r["lease_id"] not in gone}
    assert len(got) == len({r["lease_id"] for r in got})


@pytest.mark.parametrize("n, s", [(10, 86400), (None, 86400)])
def test_cadence_stream_equals_batch(spark, folder, n, s):
    log = views.step_log(spark, SF_DIR).select("event_id", "job_id", "step", "ts")
    stream = staged(spark, folder, log, 3, "ts", "event_id")
    out = runs.run_to_table(stateful.checkpoint_cadence_stream(stream, n, s), f"{folder}/out")
    want = cadence.checkpoint_cadence(log, n, s)
    pick = lambda df: {r["event_id"]: r["saved"] for r in df.collect()}
    assert pick(out) == pick(want)


def test_cadence_stream_survives_nulls(spark, folder):
    """Rows without step or time, a whole batch of them too, and a step that comes again."""
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(1, 7, 0, at(0)), (2, 7, None, at(1)), (3, 7, 1, None), (4, 8, None, None), (5, 7, 1, at(9)),
            (6, 7, 1, at(30)), (7, 7, 2, at(45)), (8, 7, None, at(99)), (9, 7, 4, at(50))]
    schema = "event_id bigint, job_id bigint, step int, ts timestamp_ntz"
    for part in (rows[:3], rows[3:5], rows[5:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = runs.run_to_table(stateful.checkpoint_cadence_stream(stream, 4, 1200), f"{folder}/out")
    got = {r["event_id"]: r["saved"] for r in out.collect()}
    assert got == {i: i in (6, 9) for i in range(1, 10)}


def test_quota_stream_equals_batch(spark, folder):
    ops = views.buffer_op(spark, SF_DIR)
    stream = staged(spark, folder, ops, 3, "ts", "event_id")
    out = runs.run_to_table(stateful.quota_stream(stream), f"{folder}/out")
    pick = lambda df: {r["event_id"]: (r["ok"], r["usage"]) for r in df.collect()}
    assert pick(out) == pick(quota.quota_fold(ops))


def test_dedupe_stream_drops_late_rows(spark, folder):
    def at(minutes):
        return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)

    # A row is late for a batch when it is behind the watermark the batch before worked with.
    rows = [(0, at(0), 1), (1, at(1), 1), (2, at(300), 2), (3, at(301), 2), (5, at(302), 2), (4, at(2), 3)]
    schema = "event_id bigint, ts timestamp_ntz, job_id bigint"
    for i, part in enumerate((rows[:2], rows[2:4], rows[4:5], rows[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = runs.run_to_table(dedupe.dedupe_stream(stream, "1 hour"), f"{folder}/out")
    assert sorted(r["job_id"] for r in out.collect()) == [1, 2]
