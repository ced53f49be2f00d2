"""Named queries: sources, sinks and streams; their files lie in the scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import remote
from ..functions.times import micros
from ..operators import checkpoints as ck
from ..operators import latency as lt
from ..operators import leases as ls
from ..operators.checkpoints import save_record
from ..sources import control as ctl
from ..sources import files, tables
from ..streaming import dedupe, expiry, live, metadata, runs, stateful
from . import views
from .fixture_sql import over
from .queries_functions import _count_or_fail, _join_counts
from .queries_catalog import _CADENCE, _METADATA
from .queries_leases import _QUOTA
from .queries_report import _STATS, _rounded
from .registry import query
from .scratch import scratch_dir, written

_SUPPLIER_SAVES = """SELECT s_nationkey AS job_id, s_suppkey AS step, CASE s_suppkey % 3 WHEN 0 THEN 'pytorch' WHEN 1 THEN 'sklearn' ELSE 'xgboost' END AS framework, s_acctbal AS balance FROM supplier"""


def _supplier_saves(spark, sf_dir):
    """One save per supplier: a small table, because each row becomes a file."""
    kind = F.col("s_suppkey") % 3
    saves = views.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("job_id"),
        F.col("s_suppkey").cast("int").alias("step"),
        F.when(kind == 0, "pytorch").when(kind == 1, "sklearn").otherwise("xgboost").alias("framework"),
        F.col("s_acctbal").alias("created_at"),
    )
    return save_record(saves).withColumn("extra", F.create_map(F.lit("auto"), F.lit("true")))


def _folder(spark, sf_dir, suffix, content):
    path = scratch_dir(spark, "files")
    name = F.concat_ws("/", "job_id", F.concat("filename", F.lit(suffix)))
    rows = _supplier_saves(spark, sf_dir).select(name.alias("name"), content.alias("content"))
    files.write_named_files(rows, path)
    return path


_NAME = """concat('ckpt_0_', step, CASE framework WHEN 'pytorch' THEN '.pt' WHEN 'sklearn' THEN '.pkl' ELSE '.json' END)"""


@query(
    "read_sidecars",
    f"""
SELECT CAST(job_id AS VARCHAR) AS job_id, 0 AS epoch, CAST(step AS INT) AS step, framework, balance AS created_at,
  'true' AS auto, {_NAME} AS filename FROM ({_SUPPLIER_SAVES})""",
)
def read_sidecars(spark, sf_dir):
    path = _folder(spark, sf_dir, ".meta.json", files.sidecar_text())
    auto = F.try_element_at("extra", F.lit("auto")).alias("auto")
    return files.read_sidecars(spark, path).select(
        "job_id", "epoch", "step", "framework", "created_at", auto, "filename"
    )


@query(
    "scan_files",
    f"""
SELECT {_NAME} AS filename, CAST(job_id AS VARCHAR) AS job_id, CAST(length(framework) AS BIGINT) AS bytes FROM ({_SUPPLIER_SAVES})""",
)
def scan_files(spark, sf_dir):
    path = _folder(spark, sf_dir, "", F.col("framework"))
    return files.scan_files(spark, path).select(
        "filename", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("job_id"), "bytes"
    )


@query(
    "read_lock_records",
    """
SELECT concat(s_suppkey, '.lock') AS file, s_suppkey + 100 AS pid, s_name AS owner, s_nationkey AS device,
  CAST(s_suppkey % 1000 AS INT) AS fraction_pm, concat('partition_', s_suppkey) AS partition_id FROM supplier""",
)
def read_lock_records(spark, sf_dir):
    path = scratch_dir(spark, "locks")
    number = F.col("s_suppkey")
    lines = [
        F.concat(F.lit("pid: "), number + 100),
        F.concat(F.lit("user: "), F.col("s_name")),
        F.concat(F.lit("device: "), F.col("s_nationkey")),
        F.concat(F.lit("fraction: "), number % 1000),
        F.concat(F.lit("partition: partition_"), number),
        F.lit(""),
    ]
    rows = views.table(spark, sf_dir, "supplier").select(
        F.concat(number, F.lit(".lock")).alias("name"), F.concat_ws("\n", *lines).alias("content")
    )
    files.write_named_files(rows, path)
    return files.read_lock_records(spark, path)


@query(
    "write_artifacts",
    over(
        "artifact_l1",
        """
SELECT job_id, regexp_replace(name, '^.*/', '') AS name, content, saved_at + 1 AS saved_at FROM artifact_l1""",
    ),
)
def write_artifacts(spark, sf_dir):
    path = scratch_dir(spark, "artifacts")
    first = views.artifact_l1(spark, sf_dir)
    tables.write_artifacts(first.withColumn("content", F.lit("old")), path)
    tables.write_artifacts(first.withColumn("saved_at", F.col("saved_at") + 1), path)
    return tables.read_artifacts(spark, path).select(
        "job_id", "name", F.col("content").cast("string").alias("content"), "saved_at"
    )


@query(
    "results_csv",
    over(
        "latency",
        """
SELECT name, round(avg(ms), 6) AS mean_ms, round(stddev_pop(ms), 6) AS stddev_ms, round(min(ms), 6) AS min_ms,
  round(max(ms), 6) AS max_ms FROM latency GROUP BY name""",
    ),
)
def results_csv(spark, sf_dir):
    path = scratch_dir(spark, "results")
    tables.write_results_csv(_rounded(lt.latency_summary(views.latency(spark, sf_dir))), path)
    return tables.read_results_csv(spark, path).select("name", *_STATS)


@query(
    "write_job_outcomes",
    """
SELECT CASE WHEN max(value) > 400 THEN 'error' ELSE 'result' END AS kind, user_id,
  CASE WHEN max(value) > 400 THEN 'ValueError: value above 400' ELSE concat('{"n": ', count(*), '}') END AS text
FROM events GROUP BY user_id""",
)
def write_job_outcomes(spark, sf_dir):
    path = scratch_dir(spark, "outcomes")
    rows = views.table(spark, sf_dir, "events").select("user_id", "value")
    outcomes = remote.capture_outcomes(rows, _count_or_fail, "user_id", _join_counts)
    tables.write_job_outcomes(outcomes, path)
    good = tables.read_job_results(spark, path).select(
        F.lit("result").alias("kind"), "user_id", F.col("result").alias("text")
    )
    bad = tables.read_job_errors(spark, path).select(
        F.lit("error").alias("kind"), "user_id", F.col("error").alias("text")
    )
    return good.unionByName(bad)


def _cents(batch):
    return batch.select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


class PauseAfter:
    """A control that asks for a pause once so many batches are saved."""

    def __init__(self, batches):
        self.left = batches

    def pause_requested(self):
        self.left -= 1
        return self.left < 0

    def mark(self, status):
        pass


def _staged(spark, df, purpose, parts=4):
    """A derived table written in the order of time, a folder for each part, read as a stream.

    A batch is one folder: all have the same number of files, as many as the table has
    splits, filled up with empty ones where a part has fewer rows. Rows without a time come
    first. The bounds are within a thousandth of the rows; each row is in one part anyway.
    """
    path = scratch_dir(spark, purpose)
    stored = written(df, purpose)
    at = F.coalesce(micros("ts"), F.lit(-(2**62)))
    points = [i / parts for i in range(1, parts)]
    bounds = stored.select(at.alias("at")).approxQuantile("at", points, 0.001)
    bounds = [int(b) for b in bounds] or [0] * len(points)
    many = stored.rdd.getNumPartitions()
    low = None
    for k, high in enumerate([*bounds, None]):
        part = stored if low is None else stored.filter(at > low)
        part = part if high is None else part.filter(at <= high)
        folder = f"{path}/{k}"
        part.repartition(many).write.parquet(folder)
        files_done = len(spark.read.schema(df.schema).parquet(folder).inputFiles())
        for _ in range(many - files_done):
            stored.limit(0).write.mode("append").parquet(folder)
        low = high
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", many)
    return source.parquet(f"{path}/*")


@query(
    "resumable_run",
    """
SELECT 'paused' AS first_status, 2 AS first_batches, 4 AS batches, event_type, count(*) AS n,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type""",
)
def resumable_run(spark, sf_dir):
    """Four batches, left after two, taken up again, and started once more with nothing left."""
    path = scratch_dir(spark, "run")
    source = _staged(spark, views.table(spark, sf_dir, "events"), "events")
    first = runs.resumable_run(source, path, _cents, PauseAfter(2))
    runs.resumable_run(source, path, _cents)
    last = runs.resumable_run(source, path, _cents)
    done = runs.output(spark, path)
    totals = done.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return totals.select(
        F.lit(first.status).alias("first_status"),
        F.lit(first.checkpoint["batches"]).cast("int").alias("first_batches"),
        F.lit(last.checkpoint["batches"]).cast("int").alias("batches"),
        "*",
    )


@query(
    "last_checkpoint_info",
    "SELECT CAST(3 AS BIGINT) AS batch_id, CAST(4 AS BIGINT) AS batches, count(*) AS rows_done FROM events",
)
def last_checkpoint_info(spark, sf_dir):
    path = scratch_dir(spark, "run")
    source = _staged(spark, views.table(spark, sf_dir, "events"), "events")
    runs.resumable_run(source, path, _cents)
    last = runs.last_checkpoint_info(spark, path)
    return last.select(F.col("last.batch_id").cast("bigint").alias("batch_id"), "batches", "rows_done")


@query(
    "cooperative_pause",
    """
SELECT 'paused' AS first_status, 'completed' AS second_status, event_type, count(*) AS n FROM events GROUP BY event_type""",
)
def cooperative_pause(spark, sf_dir):
    path = scratch_dir(spark, "run")
    control = ctl.Control(spark, f"{path}/control")
    source = views.stream(spark, sf_dir, "events")
    control.pause()
    first = runs.resumable_run(source, path, _cents, control)
    control.resume()
    second = runs.resumable_run(source, path, _cents, control)
    return (
        runs.output(spark, path)
        .groupBy("event_type")
        .agg(F.count("*").alias("n"))
        .select(
            F.lit(first.status).alias("first_status"),
            F.lit(second.status).alias("second_status"),
            "event_type",
            "n",
        )
    )


class PausingAt:
    """Counts the batches it sees and has the run paused while one of them is at work."""

    def __init__(self, control, batch):
        self.control = control
        self.left = batch

    def __call__(self, batch):
        self.left -= 1
        if self.left == 0:
            self.control.pause()
        return _cents(batch)


@query(
    "pause_between_batches",
    """
SELECT 'paused' AS first_status, 2 AS first_batches, 'completed' AS second_status, 4 AS batches, event_type,
  count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type""",
)
def pause_between_batches(spark, sf_dir):
    """The control record asks for a pause while the second of four batches is at work."""
    path = scratch_dir(spark, "run")
    control = ctl.Control(spark, f"{path}/control")
    source = _staged(spark, views.table(spark, sf_dir, "events"), "events")
    first = runs.resumable_run(source, path, PausingAt(control, 2), control)
    control.resume()
    second = runs.resumable_run(source, path, _cents, control)
    totals = runs.output(spark, path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return totals.select(
        F.lit(first.status).alias("first_status"),
        F.lit(first.checkpoint["batches"]).cast("int").alias("first_batches"),
        F.lit(second.status).alias("second_status"),
        F.lit(second.checkpoint["batches"]).cast("int").alias("batches"),
        "*",
    )


@query(
    "live_progress",
    """
SELECT CAST(2 AS BIGINT) AS live_at_stop, CAST(4 AS BIGINT) AS batches, count(*) AS rows_saved, count(*) AS rows_live,
  CAST(0 AS BIGINT) AS unlike FROM events""",
)
def live_progress(spark, sf_dir):
    """What Spark reported of each batch beside what was saved with it, over a stop in mid-run."""
    path = scratch_dir(spark, "run")
    source = _staged(spark, views.table(spark, sf_dir, "events"), "events")
    runs.resumable_run(source, path, _cents, PauseAfter(2))
    at_stop = live.live_progress(spark, f"{path}/live").count()
    runs.resumable_run(source, path, _cents)
    saved = runs.progress(spark, path).select("batch_id", F.col("rows").alias("saved"))
    seen = live.live_progress(spark, f"{path}/live").select("batch_id", F.col("rows").alias("seen"))
    return saved.join(seen, "batch_id", "full").agg(
        F.lit(at_stop).cast("bigint").alias("live_at_stop"),
        F.count("*").alias("batches"),
        F.sum("saved").alias("rows_saved"),
        F.sum("seen").alias("rows_live"),
        F.count_if(~F.col("saved").eqNullSafe(F.col("seen"))).alias("unlike"),
    )


@query("job_metadata_stream", over("ckpt", _METADATA))
def job_metadata_stream(spark, sf_dir):
    """Checkpoints in four batches, each merged into the stored record of its jobs."""
    saved = views.ckpt(spark, sf_dir).select("job_id", "tier", "filename", "step", "ts")
    saved = saved.withColumns(
        {"epoch": F.col("step") % 3, "machine": F.concat(F.lit("machine"), F.col("step") % 4)}
    )
    path = scratch_dir(spark, "metadata")
    source = _staged(spark, saved, "saves")
    metadata.run_job_metadata(source, path)
    metadata.run_job_metadata(source, path)
    shown = metadata.read_job_metadata(spark, f"{path}/data")
    return shown.select("*", "checkpoint_paths.*").drop("checkpoint_paths")


@query("dedupe_submissions_stream", over("submission", "SELECT DISTINCT job_id FROM submission"))
def dedupe_submissions_stream(spark, sf_dir):
    rows = views.submission_of(views.stream(spark, sf_dir, "events"))
    seen = dedupe.dedupe_stream(rows, "40 days")
    return runs.run_to_table(seen.select("job_id"), scratch_dir(spark, "dedupe"))


@query(
    "expire_stream",
    over(
        "lease",
        """
SELECT lease_id, device_id, owner, end_ts AS expired_at FROM lease WHERE duration_s > 0
  AND end_ts <= (SELECT date_trunc('milliseconds', max(start_ts)) FROM lease WHERE duration_s > 0)""",
    ),
)
def expire_stream(spark, sf_dir):
    leases = views.lease_of(views.stream(spark, sf_dir, "events"))
    return runs.run_to_table(expiry.expire_stream(leases), scratch_dir(spark, "expiry"))


@query(
    "checkpoint_cadence_stream",
    over("step_log", "WITH steps AS MATERIALIZED (SELECT * FROM step_log)," + _CADENCE[6:], True),
)
def checkpoint_cadence_stream(spark, sf_dir):
    log = _staged(spark, views.step_log(spark, sf_dir), "steps")
    saved = stateful.checkpoint_cadence_stream(log, 10, 86400)
    return runs.run_to_table(
        saved.select("job_id", "event_id", "step", "saved"), scratch_dir(spark, "cadence")
    )


@query("quota_stream", over("buffer_op", _QUOTA, recursive=True))
def quota_stream(spark, sf_dir):
    ops = _staged(spark, views.buffer_op(spark, sf_dir), "ops")
    folded = stateful.quota_stream(ops).select("event_id", "key", "ok", "usage")
    return runs.run_to_table(folded, scratch_dir(spark, "quota"))


@query(
    "quarantine_stream",
    over(
        "lease device",
        """
SELECT lease_id, fraction_pm, CASE WHEN d.device_id IS NULL THEN 'device' WHEN NOT (fraction_pm BETWEEN 1 AND 1000)
  THEN 'fraction' WHEN NOT duration_s > 0 THEN 'duration' END AS reason
FROM (SELECT * REPLACE (lease_id % 9 AS device_id, CAST(fraction_pm * 2 AS INT) AS fraction_pm) FROM lease) l
LEFT JOIN device d ON d.device_id = l.device_id""",
    ),
)
def quarantine_stream(spark, sf_dir):
    """Leases as a stream, validated; good rows and the others in tables of their own."""
    asked = views.lease_of(views.stream(spark, sf_dir, "events")).withColumns(
        {"device_id": F.col("lease_id") % 9, "fraction_pm": F.col("fraction_pm") * 2}
    )
    checked = ls.validate_leases(asked, views.device(spark, sf_dir))
    path = scratch_dir(spark, "split")
    tables.run_split_sink(checked, path)
    tables.run_split_sink(checked, path)
    good = tables.read_split(checked, path, "good")
    return good.unionByName(tables.read_split(checked, path, "quarantine")).select(
        "lease_id", "fraction_pm", "reason"
    )


#: Checkpoints whose files lie on disk at once, unless one job has more.
_PORTION = 100_000


@query(
    "retain_files",
    over(
        "ckpt",
        """
SELECT CAST(job_id AS VARCHAR) AS job_id, tier, filename, step, CAST(bytes AS BIGINT) AS bytes,
  concat('before ', total, ', removed ', 2 * gone) AS said
FROM (SELECT job_id, tier, filename, step, CAST(length(framework) AS BIGINT) AS bytes, rn, count(*) OVER () AS total,
  count(*) FILTER (rn > 5) OVER () AS gone
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, tier ORDER BY ts DESC, step DESC, filename DESC) AS rn
        FROM ckpt)) WHERE rn <= 5""",
    ),
)
def retain_files(spark, sf_dir, portion=_PORTION):
    """Checkpoints as real files of two tiers: listed, all but five of each group removed, listed.

    The smallest file takes a block of the disk, so jobs go through all of this in portions:
    a portion's folder, with the files that were kept, goes once its last listing is written.
    """
    path = scratch_dir(spark, "tiers")
    saves = written(
        views.ckpt(spark, sf_dir).select("job_id", "tier", "filename", "framework", "step", "ts"), "saves"
    )
    number = max(1, -(-saves.count() // portion))
    dealt = F.pmod(F.xxhash64("job_id"), F.lit(number))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = gone = 0
    for i in range(number):
        folder = f"{path}/{i}"
        before, removed, last = _retain_portion(saves.filter(dealt == i).repartition(tasks), folder)
        last.write.mode("append").parquet(f"{path}/listed")
        files.remove_folder(folder)
        total, gone = total + before, gone + removed
    said = F.format_string("before %d, removed %d", F.lit(total), F.lit(2 * gone))
    return spark.read.schema(last.schema).parquet(f"{path}/listed").withColumn("said", said)


def _retain_portion(saves, path):
    """Writes the files of these saves, applies retention; files before, removed, and the rest."""
    spark = saves.sparkSession
    name = F.concat_ws("/", "tier", "job_id", "filename")
    saved = saves.select(
        name.alias("name"),
        "framework",
        F.lit(0).alias("epoch"),
        "step",
        F.col("job_id").cast("string").alias("job_id"),
        micros("ts").cast("double").alias("created_at"),
        F.create_map(F.lit("auto"), F.lit("true")).alias("extra"),
    )
    data = F.struct("name", F.col("framework").alias("content"))
    sidecar = F.concat("name", F.lit(ck.SIDECAR_SUFFIX)).alias("name")
    described = F.struct(sidecar, files.sidecar_text().alias("content"))
    tiers = {tier: f"{path}/{tier}" for tier in ("L1", "L2")}
    files.make_folders(tiers.values())
    files.write_named_files(saved.select(F.inline(F.array(data, described))), path)

    def listed():
        sidecars, found = files.catalog(spark, tiers)
        steps = sidecars.select("job_id", "tier", "filename", "step", F.col("created_at").alias("ts"))
        return found.drop("ts").join(steps, ["job_id", "tier", "filename"])

    plan = written(ck.retention(written(listed(), "found")), "plan")
    removed = files.remove_files(plan.filter(F.col("action") == "remove"))
    return plan.count(), removed, listed().select("job_id", "tier", "filename", "step", "bytes")
