import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import artifacts as art
from tidemark.operators import checkpoints as ck
from tidemark.plans import queries_streams as streams
from tidemark.sources import files as src
from tidemark.sources import tables

FILES = "job_id bigint, tier string, filename string, step int, ts timestamp_ntz, bytes bigint"
SIDE = "job_id bigint, tier string, filename string, epoch int, step int, framework string, ts timestamp_ntz"


def at(n):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)


def files(spark, *rows):
    return spark.createDataFrame([(1, t, f, s, at(x), 10) for t, f, s, x in rows], FILES)


def sidecars(spark, *rows):
    return spark.createDataFrame([(1, t, f, 1, 2, fw, at(x)) for t, f, fw, x in rows], SIDE)


def test_listing(spark):
    f = files(spark, ("L1", "ckpt_1_2.pt", 2, 50), ("L1", "ckpt_0_9.pt", 9, 70), ("L1", "other.pt", 0, 80),
              ("L2", "other.pt", 0, 90), ("L2", "ckpt_0_1.pkl", 1, 95), ("L1", "ckpt_1_2.pt.meta.json", 0, 99))
    s = sidecars(spark, ("L1", "ckpt_1_2.pt", "pytorch", 51), ("L2", "gone.pkl", None, 60))
    rows = ck.list_checkpoints(s, f).collect()
    assert [(r["filename"], r["tier"], r["framework"], r["step"]) for r in rows] == [
        ("other.pt", "L2", "pytorch", 0),
        ("ckpt_0_9.pt", "L1", "pytorch", 0),
        ("gone.pkl", "L2", "unknown", 2),
        ("ckpt_1_2.pt", "L1", "pytorch", 2),
    ]
    assert rows[3]["ts"] == at(50) and rows[2]["ts"] == at(60)
    legacy = ck.legacy_checkpoints(s, f).collect()
    assert {(r["tier"], r["filename"]) for r in legacy} == {("L1", "ckpt_0_9.pt"), ("L2", "other.pt")}


def test_latest_prefers_l1_and_never_a_sidecar(spark):
    f = files(spark, ("L1", "ckpt_0_1.pt", 1, 10), ("L1", "ckpt_0_2.pt.meta.json", 2, 99), ("L2", "ckpt_0_3.pt", 3, 50))
    assert ck.latest_checkpoint(f).first()["filename"] == "ckpt_0_1.pt"
    only_l2 = f.filter("tier = 'L2'")
    assert ck.latest_checkpoint(only_l2).first()["filename"] == "ckpt_0_3.pt"


@pytest.mark.parametrize(
    "hint, name, module, want",
    [(" Torch ", "a.txt", None, "pytorch"), ("keras", "a.pt", None, "tensorflow"), (None, "a.weights.h5", None, "tensorflow"),
     ("?", "x", "xgboost.sklearn", "xgboost"), ("lgbm", "x", None, "lightgbm"), (None, "x", None, "pytorch")],
)
def test_infer_framework(spark, hint, name, module, want):
    cols = [F.lit(v).cast("string") for v in (hint, name, module)]
    assert spark.range(1).select(ck.infer_framework(*cols).alias("f")).first()["f"] == want


@pytest.mark.parametrize("keep", [1, 2, 10, 1001])
def test_retention_with_equal_stamps_and_a_hot_job(spark, keep):
    rows = [(1, "L1", f"ckpt_0_{i}.pt", i, at(i // 3), 1) for i in range(300)] + [(2, "L2", "ckpt_0_1.pt", 1, at(1), 1)]
    got = ck.retention(spark.createDataFrame(rows, FILES).repartition(6), keep).collect()
    kept = {(r["job_id"], r["step"]) for r in got if r["action"] == "keep"}
    assert kept == {(1, i) for i in range(max(0, 300 - keep), 300)} | {(2, 1)}
    assert len(got) == 301


def test_eviction_at_the_cap(spark):
    f = files(spark, ("L1", "a", 1, 0), ("L1", "b", 2, 100), ("L1", "c", 3, 200), ("L1", "d", 4, 4000))
    now = F.lit(at(4000)).cast("timestamp_ntz")
    got = {r["filename"]: r["reason"] for r in ck.cache_eviction(f, now, 30, 3900).collect()}
    assert got == {"d": None, "c": None, "b": None, "a": "ttl"}
    tight = {r["filename"]: r["reason"] for r in ck.cache_eviction(f, now, 20, 10000).collect()}
    assert tight == {"d": None, "c": None, "b": "size", "a": "size"}


def test_folders_as_a_catalog(spark, folder):
    l1, job = f"{folder}/l1", f"{folder}/l1/7"
    os.makedirs(job)
    meta = '{"framework": "sklearn", "epoch": 3, "step": 4, "job_id": "7", "created_at": 1.5,\n "extra": {"k": "v"}}'
    stamps = [("ckpt_3_4.pkl", "x"), ("ckpt_3_4.pkl.meta.json", meta), ("ckpt_0_1.pt", "yy"), ("bad.pt.meta.json", "{nope")]
    for i, (name, text) in enumerate(stamps):
        with open(f"{job}/{name}", "w") as out:
            out.write(text)
        os.utime(f"{job}/{name}", (1e9 + i, 1e9 + i))
    assert tuple(src.count_broken_sidecars(spark, l1).first()) == (1, 1)
    side, data = src.catalog(spark, {"L1": l1})
    rows = ck.list_checkpoints(side, data).collect()
    assert [(r["filename"], r["epoch"], r["framework"], r["job_id"]) for r in rows] == [
        ("ckpt_0_1.pt", 0, "pytorch", "7"),
        ("ckpt_3_4.pkl", 3, "sklearn", "7"),
    ]
    assert src.remove_files(data.filter("filename = 'ckpt_3_4.pkl'")) == 1
    assert sorted(os.listdir(job)) == ["bad.pt.meta.json", "ckpt_0_1.pt"]
    assert src.scan_files(spark, l1).select("path").count() == 2


def test_scan_never_reads_content(spark, folder):
    os.makedirs(folder)
    open(f"{folder}/a.bin", "wb").write(b"12345")
    df = src.scan_files(spark, folder)
    assert df.first()["bytes"] == 5
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_artifacts(spark, folder):
    art_schema = "job_id string, name string, content string, saved_at bigint"
    l1 = spark.createDataFrame([("j", "a/../x.txt", "one", 1), ("j", "ckpt_1.bin", "c", 2), ("j", "m.pt", "p", 3)], art_schema)
    l2 = spark.createDataFrame([("j", "x.txt", "two", 9), ("j", "m.pt", "p2", 4), ("j", "y", "far", 5)], art_schema)
    ask = spark.createDataFrame([("j", "x.txt"), ("j", "dir/y"), ("j", "z"), ("k", "y")], "job_id string, name string")
    got = {(r["job_id"], r["name"]): (r["source"], r["content"], r["status"]) for r in art.load_artifacts(ask, l1, l2).collect()}
    assert got == {("j", "x.txt"): ("L1", "one", "found"), ("j", "dir/y"): ("L2", "far", "found"),
                   ("j", "z"): (None, None, "not_found"), ("k", "y"): (None, None, "not_found")}
    listed = [(r["name"], r["source"][:2]) for r in art.list_artifacts(l1, l2).collect()]
    assert listed == [("x.txt", "L2"), ("y", "L2"), ("m.pt", "L2"), ("x.txt", "L1")]
    tables.write_artifacts(l1, folder)
    tables.write_artifacts(l1.withColumn("content", F.lit("new")).withColumn("saved_at", F.lit(50).cast("bigint")), folder)
    now = {r["name"]: bytes(r["content"]) for r in tables.read_artifacts(spark, folder).collect()}
    assert now == {"x.txt": b"new", "ckpt_1.bin": b"new", "m.pt": b"new"}
    tables.compact_artifacts(spark, folder, folder + "-compact")
    assert tables.read_artifacts(spark, folder + "-compact").count() == 3


def test_job_ids_that_look_like_numbers(spark, folder):
    rows = [("007", "a", "one", 1), ("7", "a", "two", 1), ("1e3", "a", "three", 1), ("7", "a", "three", 1)]
    saved = spark.createDataFrame(rows, "job_id string, name string, content string, saved_at bigint")
    tables.write_artifacts(saved, folder)
    got = {r["job_id"]: bytes(r["content"]) for r in tables.read_artifacts(spark, folder).collect()}
    assert got == {"007": b"one", "7": b"two", "1e3": b"three"}
    tables.delete_artifacts(spark, folder, saved.filter("job_id = '7'"), folder + "-rest")
    left = tables.read_artifacts(spark, folder + "-rest").collect()
    assert {r["job_id"] for r in left} == {"007", "1e3"}


def test_delete_rows_in_place(spark, folder):
    """Doomed keys go, folders without them keep their files, an emptied folder is gone."""
    rows = spark.range(4000).select((F.col("id") % 40).alias("job_id"), F.col("id").alias("item"))
    rows = rows.unionByName(rows.limit(3).withColumn("job_id", F.lit(None).cast("bigint")))
    tables.write_by_key(rows, folder, parts=16, spread=2)
    part = F.pmod(F.xxhash64("job_id"), F.lit(16)).cast("int")
    owners = {r["part"]: set(r["jobs"]) for r in rows.groupBy(part.alias("part")).agg(F.collect_set("job_id").alias("jobs")).collect()}
    whole = next(p for p, jobs in owners.items() if len(jobs) == 1)
    some = next(p for p, jobs in owners.items() if len(jobs) > 2)
    gone = owners[whole] | {min(owners[some])}
    files = lambda: {f for f in spark.read.parquet(folder).inputFiles()}
    of = lambda fs, p: {f for f in fs if f"part={p}/" in f}
    before = files()
    doomed = spark.createDataFrame([(j,) for j in gone] + [(None,), (999,)], "job_id bigint")
    for _ in range(2):
        tables.delete_rows(spark, folder, doomed, parts=16, spread=2)
        left = tables.read_by_key(spark, folder)
        assert left.filter(F.col("job_id").isin(list(gone))).count() == 0
        assert left.count() == 4003 - 100 * len(gone)
    after = files()
    assert not of(after, whole)
    hit = {whole, some, spark.range(1).select(F.pmod(F.xxhash64(F.lit(999).cast("bigint")), F.lit(16)).alias("p")).first()["p"]}
    for p in set(owners) - hit:
        assert of(after, p) == of(before, p)
    with pytest.raises(ValueError, match="in place"):
        tables.delete_artifacts(spark, folder, doomed, folder + "/")


def test_replayed_batch_leaves_one_copy(spark, folder):
    save = tables.split_sink(folder)
    batch = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "id int, reason string")
    save(batch, 0)
    save(batch.limit(1), 1)
    save(batch, 0)
    got = spark.read.parquet(folder)
    assert got.groupBy("kind").count().orderBy("kind").collect() == [("good", 3), ("quarantine", 1)]


def test_paths_as_the_store_names_them():
    assert src.as_store_uri("s3a://b/k") == "s3://b/k"
    assert src.as_store_uri("file:/tmp/x") == src.as_store_uri("/tmp/x") == "file:///tmp/x"
    assert src.as_store_uri("hdfs://h/x") == "hdfs://h/x"


def test_csv_round_trip(spark, folder):
    rows = [("create", 0.65, 0.16, 0.18, 1.14, 100)]
    schema = "name string, mean_ms double, stddev_ms double, min_ms double, max_ms double, iterations bigint"
    tables.write_results_csv(spark.createDataFrame(rows, schema), folder)
    assert tuple(tables.read_results_csv(spark, folder).first()) == rows[0][:5]


def test_files_are_listed_by_tasks(spark, folder):
    """Spark's readers would keep each file's status in the driver: no plan names the files."""
    texts = {
        "a/x.pt.meta.json": '{"framework":"pytorch","step":3}',
        "a/b c/y z%.pt.meta.json": '{"step":4}',
        "a/x.pt": "abc",
        "a/empty.pt": "",
        "a/_hidden.pt": "x",
        "a/_kept=1.pt": "x",
        ".secret/x.pt": "x",
        "top.pt": "x",
    }
    for name, text in texts.items():
        target = Path(folder) / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    found = src.scan_files(spark, folder)
    sidecars = src.read_sidecars(spark, folder)
    for df in (found, sidecars):
        assert not [f for f in df.inputFiles() if "/listing-" not in f]
    kept = {"x.pt.meta.json", "y z%.pt.meta.json", "x.pt", "_kept=1.pt", "top.pt"}
    assert {r["filename"] for r in found.collect()} == kept
    assert {r["path"] for r in found.filter("filename = 'top.pt'").collect()} == {f"file:{folder}/top.pt"}
    assert sorted((r["filename"], r["step"]) for r in sidecars.collect()) == [("x.pt", 3), ("y%20z%25.pt", 4)]
    # A pattern of paths is left to Spark's reader.
    assert {r["filename"] for r in src.scan_files(spark, f"{folder}/[t]*").collect()} == {"top.pt"}
    assert {r["filename"] for r in src.scan_files(spark, folder, "*.pt").collect()} == kept - {"x.pt.meta.json", "y z%.pt.meta.json"}


def test_retained_files_lie_on_disk_in_portions(spark, folder, monkeypatch):
    """Each small file takes a block of the disk: only the files of some jobs are there at once."""
    rows = [(i, at(60 * i), None if i % 7 == 6 else i % 7, "click", 1.0) for i in range(420)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/events.parquet")
    written, present = src.write_named_files, []

    def counted(df, path):
        done = written(df, path)
        below = Path(path.removeprefix("file://")).parent
        present.append(sum(len(names) for _, _, names in os.walk(below)))
        return done

    monkeypatch.setattr(src, "write_named_files", counted)
    got = streams.retain_files(spark, folder, portion=60).collect()
    assert len(present) == 6 and max(present) < 2 * 350
    assert sorted(got, key=str) == sorted(streams.retain_files(spark, folder).collect(), key=str)
    assert len(got) == 7 * 2 * 5
    assert {r["said"] for r in got} == {"before 350, removed 560"}
    assert {r["job_id"] for r in got if r["step"] > 50} == {"0", "1", "2", "3", "4", "5", "L1", "L2"}


def test_a_catalog_lists_its_folders_once(spark, folder, monkeypatch):
    for tier in ("l1", "l2"):
        os.makedirs(f"{folder}/{tier}/7")
        Path(f"{folder}/{tier}/7/ckpt_0_1.pt").write_text(tier)
        Path(f"{folder}/{tier}/7/ckpt_0_1.pt.meta.json").write_text('{"step": 1}')
    listing, asked = src._listing, []
    monkeypatch.setattr(src, "_listing", lambda spark, paths: asked.append(paths) or listing(spark, paths))
    side, data = src.catalog(spark, {"L1": f"{folder}/l1", "L2": f"{folder}/l2"})
    assert len(asked) == 1
    assert sorted((r["tier"], r["job_id"], r["filename"]) for r in side.collect()) == [
        ("L1", "7", "ckpt_0_1.pt"),
        ("L2", "7", "ckpt_0_1.pt"),
    ]
    assert sorted((r["tier"], r["path"], r["bytes"]) for r in data.collect()) == [
        ("L1", f"file:{folder}/l1/7/ckpt_0_1.pt", 2),
        ("L2", f"file:{folder}/l2/7/ckpt_0_1.pt", 2),
    ]
