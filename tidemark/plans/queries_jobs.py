"""Named queries: job records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs
from ..sources import tables
from . import views
from .fixture_sql import over
from .registry import query
from .scratch import scratch_dir, written

_LOG = """
SELECT *, CASE WHEN status = 'failed' THEN concat('error ', event_id) END AS error,
  CASE WHEN status = 'running' THEN concat('partition_', event_id) END AS partition_id FROM job_event"""

_CURRENT = f"""
SELECT job_id, arg_max(status, (ts, event_id)) AS status, min(ts) AS created_at,
  min(ts) FILTER (status = 'running') AS started_at,
  max(ts) FILTER (status IN ('completed', 'failed', 'timeout', 'cancelled')) AS ended_at,
  max(ts) AS updated_at, arg_max(error, (ts, event_id)) FILTER (error IS NOT NULL) AS error,
  arg_max(partition_id, (ts, event_id)) FILTER (partition_id IS NOT NULL) AS partition_id
FROM ({_LOG}) GROUP BY job_id"""


def _log(spark, sf_dir):
    """The status log with what failed and running rows say besides."""
    text = lambda word: F.concat(F.lit(word), F.col("event_id"))
    return views.job_event(spark, sf_dir).withColumns(
        {
            "error": F.when(F.col("status") == "failed", text("error ")),
            "partition_id": F.when(F.col("status") == "running", text("partition_")),
        }
    )


@query("current_status", over("job_event", _CURRENT))
def current_status(spark, sf_dir):
    return jobs.current_status(_log(spark, sf_dir))


@query("list_jobs", over("job_event", f"SELECT * FROM ({_CURRENT}) WHERE status IN ('failed', 'paused')"))
def list_jobs(spark, sf_dir):
    return jobs.list_jobs(_log(spark, sf_dir), F.col("status").isin("failed", "paused"))


@query(
    "active_jobs",
    over(
        "job_event",
        f"SELECT count(*) AS active_jobs FROM ({_CURRENT}) WHERE status IN ('pending', 'running')",
    ),
)
def active_jobs(spark, sf_dir):
    return jobs.active_jobs(views.job_event(spark, sf_dir))


@query(
    "active_jobs_as_of",
    over(
        "job_event",
        """
SELECT count(*) AS active_jobs FROM (
  SELECT job_id, arg_max(status, (ts, event_id)) AS status FROM job_event
  WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY job_id) WHERE status IN ('pending', 'running')""",
    ),
)
def active_jobs_as_of(spark, sf_dir):
    at = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return jobs.active_jobs(views.job_event(spark, sf_dir), at)


@query(
    "job_timeline",
    over(
        "job_event",
        f"""
WITH f AS (SELECT job_id, min(ts) AS created_at, min(ts) FILTER (status = 'running') AS started_at,
  min(ts) FILTER (status IN ('completed', 'failed', 'timeout', 'cancelled')) AS completed_at,
  arg_min(status, (ts, event_id)) FILTER (status IN ('completed', 'failed', 'timeout', 'cancelled')) AS final_status,
  arg_min(struct_pack(e := error), (ts, event_id)) FILTER (status IN ('completed', 'failed', 'timeout', 'cancelled')).e AS error
  FROM ({_LOG}) GROUP BY job_id)
SELECT *, CAST(trunc(epoch_us(started_at - created_at) / 1e6) AS BIGINT) AS wait_s,
  CAST(trunc((epoch_us(completed_at) - epoch_us(started_at)) / 1e6) AS BIGINT) AS run_s,
  CAST(trunc((epoch_us(completed_at) - epoch_us(created_at)) / 1e6) AS BIGINT) AS total_s FROM f""".replace(
            "epoch_us(started_at - created_at)", "(epoch_us(started_at) - epoch_us(created_at))"
        ),
    ),
)
def job_timeline(spark, sf_dir):
    return jobs.job_timeline(_log(spark, sf_dir))


@query(
    "validate_submissions",
    over(
        "submission",
        """
WITH f AS (SELECT job_id, min((ts, event_id)) AS first FROM submission
  WHERE gpu_memory BETWEEN 0 AND 1 AND duration > 0 GROUP BY job_id)
SELECT s.*, CASE WHEN (ts, event_id) > first THEN 'duplicate'
  WHEN NOT (gpu_memory BETWEEN 0 AND 1) THEN 'gpu_memory' WHEN NOT duration > 0 THEN 'duration' END AS reason
FROM submission s LEFT JOIN f ON f.job_id = s.job_id""",
    ),
)
def validate_submissions(spark, sf_dir):
    return jobs.validate_submissions(views.submission(spark, sf_dir))


@query(
    "concurrency_cap",
    over(
        "lease",
        """
WITH e AS (SELECT device_id, lease_id, start_ts AS at, 1 AS delta FROM lease WHERE duration_s > 0
  UNION ALL SELECT device_id, lease_id, end_ts, -1 FROM lease WHERE duration_s > 0),
r AS (SELECT *, sum(delta) OVER (PARTITION BY device_id ORDER BY "at", delta, lease_id ROWS UNBOUNDED PRECEDING) AS active FROM e)
SELECT device_id, CAST(max(active) AS BIGINT) AS max_active,
  count(*) FILTER (delta = 1 AND active > 5) AS breaches FROM r GROUP BY device_id""",
    ),
)
def concurrency_cap(spark, sf_dir):
    intervals = (
        views.lease(spark, sf_dir)
        .filter(F.col("duration_s") > 0)
        .select("device_id", "lease_id", "start_ts", "end_ts")
    )
    return jobs.concurrency_cap(intervals, "device_id")


@query(
    "illegal_transitions",
    over(
        "job_event",
        """
SELECT event_id, job_id, ts, status, previous FROM (
  SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous FROM job_event)
WHERE (status = 'running' AND coalesce(previous NOT IN ('pending', 'paused'), true))
   OR (status = 'paused' AND coalesce(previous <> 'running', true))
   OR (status = 'cancelled' AND coalesce(previous NOT IN ('pending', 'running'), true))""",
    ),
)
def illegal_transitions(spark, sf_dir):
    return jobs.illegal_transitions(views.job_event(spark, sf_dir))


@query(
    "dedupe_submissions",
    over(
        "submission",
        """
SELECT event_id, ts, job_id, gpu_memory, duration FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM submission) WHERE rn = 1""",
    ),
)
def dedupe_submissions(spark, sf_dir):
    return jobs.dedupe_submissions(views.submission(spark, sf_dir))


def _doomed(spark, sf_dir):
    failed = jobs.list_jobs(views.job_event(spark, sf_dir), F.col("status") == "failed")
    return failed.select("job_id")


_KEPT = f"SELECT job_id FROM ({_CURRENT}) WHERE status = 'failed'"


@query(
    "delete_jobs",
    over(
        "job_event ckpt artifact_l1",
        f"""
SELECT 'events' AS kind, job_id, CAST(event_id AS VARCHAR) AS item, status AS detail FROM job_event
WHERE job_id NOT IN ({_KEPT})
UNION ALL SELECT 'checkpoints', job_id, concat(tier, '/', filename), framework FROM ckpt
WHERE job_id NOT IN ({_KEPT})
UNION ALL SELECT 'artifacts', job_id, name, source FROM (
  SELECT saved_at % 500 AS job_id, name, job_id AS source FROM artifact_l1)
WHERE job_id NOT IN ({_KEPT})""",
    ),
)
def delete_jobs(spark, sf_dir):
    """Three tables are written, the doomed jobs are deleted from each, and what is left is read."""
    events = views.job_event(spark, sf_dir).select(
        "job_id", F.col("event_id").cast("string").alias("item"), F.col("status").alias("detail")
    )
    ckpt = views.ckpt(spark, sf_dir).select(
        "job_id", F.concat_ws("/", "tier", "filename").alias("item"), F.col("framework").alias("detail")
    )
    artifacts = views.artifact_l1(spark, sf_dir).select(
        (F.col("saved_at") % 500).alias("job_id"), F.col("name").alias("item"), F.col("job_id").alias("detail")
    )
    doomed = written(_doomed(spark, sf_dir), "doomed")
    left = []
    for kind, rows in (("events", events), ("checkpoints", ckpt), ("artifacts", artifacts)):
        path = scratch_dir(spark, kind)
        tables.write_by_key(rows, path, parts=16, spread=2)
        tables.delete_rows(spark, path, doomed, parts=16, spread=2)
        kept = tables.read_by_key(spark, path)
        left.append(kept.select(F.lit(kind).alias("kind"), "job_id", "item", "detail"))
    return left[0].unionByName(left[1]).unionByName(left[2])
