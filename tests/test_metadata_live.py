import datetime
import random

from pyspark.sql import functions as F

from tidemark.operators import checkpoints as ck
from tidemark.streaming import live, metadata, runs

T0 = datetime.datetime(2024, 5, 1)
FILES = "job_id string, tier string, filename string, step int, ts timestamp_ntz"


def files(spark, n, seed=0):
    rng = random.Random(seed)
    rows = [
        (f"job{rng.randint(0, 9)}", rng.choice(["L1", "L2"]), f"ckpt_0_{i}.pt", i, T0 + datetime.timedelta(seconds=rng.randint(0, 50)))
        for i in range(n)
    ]
    return spark.createDataFrame([*rows, (None, "L1", "x.pt", 1, None)], FILES)


def shown(df):
    return sorted(map(repr, df.collect()))


def test_batches_equal_one_run_whatever_is_replayed(spark, folder):
    rows = files(spark, 120)
    for version in (0, 1, 1, 2, 2):
        batch = rows.filter(F.coalesce(F.col("step"), F.lit(0)) % 3 == version)
        metadata.merge_job_metadata(batch, folder, version, parts=4)
    got = metadata.read_job_metadata(spark, folder)
    assert shown(got) == shown(ck.job_metadata(rows))


def test_only_touched_folders_change_and_old_versions_go(spark, folder):
    metadata.merge_job_metadata(files(spark, 200), folder, 0, parts=8)
    before = set(spark.read.parquet(folder).inputFiles())
    one = files(spark, 40, seed=1).filter("job_id = 'job3'")
    for version in (1, 2, 3):
        metadata.merge_job_metadata(one, folder, version, parts=8)
    after = set(spark.read.parquet(folder).inputFiles())
    assert len(before - after) == 1
    assert {f.split("version=")[1][0] for f in after - before} == {"2", "3"}


def test_nothing_stored(spark, folder):
    assert metadata.read_job_metadata(spark, folder) is None
    metadata.merge_job_metadata(files(spark, 5).limit(0), folder, 0)
    metadata.merge_job_metadata(files(spark, 5), folder, 1)
    assert shown(metadata.read_job_metadata(spark, folder)) == shown(ck.job_metadata(files(spark, 5)))


class StopAfter:
    def __init__(self, batches):
        self.left = batches

    def pause_requested(self):
        self.left -= 1
        return self.left < 0

    def mark(self, status):
        pass


def test_live_rows_agree_with_saved_ones_over_a_stop(spark, folder):
    for i in range(3):
        spark.range(10 * (i + 1)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def both():
        saved = runs.progress(spark, f"{folder}/run").select("batch_id", "rows").collect()
        seen = live.live_progress(spark, f"{folder}/run/live").select("batch_id", "rows").collect()
        return sorted(map(tuple, saved)), sorted(map(tuple, seen))

    assert runs.resumable_run(source, f"{folder}/run", control=StopAfter(1)).status == "paused"
    saved, seen = both()
    assert saved == seen and [b for b, _ in seen] == [0]
    assert runs.resumable_run(source, f"{folder}/run").status == "completed"
    saved, seen = both()
    assert saved == seen and sum(n for _, n in seen) == 60 and len(seen) == 3
