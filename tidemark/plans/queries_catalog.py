"""Named queries: checkpoint and artifact catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artifacts as art
from ..operators import cadence
from ..operators import checkpoints as ck
from . import views
from .fixture_sql import over
from .registry import query


def _files(spark, sf_dir):
    return views.ckpt(spark, sf_dir).select("job_id", "tier", "filename", "step", "ts", "bytes")


def _sidecars(spark, sf_dir):
    rows = views.ckpt(spark, sf_dir).filter("has_sidecar")
    return rows.select("job_id", "tier", "filename", F.lit(0).alias("epoch"), "step", "framework", "ts")


_LEGACY = "filename LIKE '%.pt' AND (tier <> 'L1' OR starts_with(filename, 'ckpt_'))"


@query(
    "list_checkpoints",
    over(
        "ckpt",
        f"""
SELECT job_id, tier, filename, 0 AS epoch, CASE WHEN has_sidecar THEN step ELSE 0 END AS step,
  CASE WHEN has_sidecar THEN framework ELSE 'pytorch' END AS framework, ts,
  CASE tier WHEN 'L1' THEN 'L1 (local)' ELSE 'L2 (S3)' END AS source, has_sidecar,
  concat('checkpoints/', job_id, '/', filename) AS path,
  CASE WHEN has_sidecar THEN concat('{{"epoch":0,"step":', step, ',"framework":"', framework, '"}}') END AS metadata
FROM ckpt WHERE has_sidecar OR ({_LEGACY})""",
    ),
)
def list_checkpoints(spark, sf_dir):
    return ck.list_checkpoints(_sidecars(spark, sf_dir), _files(spark, sf_dir))


@query(
    "legacy_checkpoints",
    over(
        "ckpt",
        f"""
SELECT job_id, tier, filename, 0 AS epoch, 0 AS step, 'pytorch' AS framework, ts
FROM ckpt WHERE NOT has_sidecar AND {_LEGACY}""",
    ),
)
def legacy_checkpoints(spark, sf_dir):
    return ck.legacy_checkpoints(_sidecars(spark, sf_dir), _files(spark, sf_dir))


@query(
    "latest_checkpoint",
    over(
        "ckpt",
        r"""
SELECT job_id, tier, filename, step, ts, bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id
    ORDER BY tier = 'L1' DESC, ts DESC, step DESC, filename DESC) AS rn
  FROM ckpt WHERE starts_with(filename, 'ckpt_') AND regexp_matches(filename, '\.(pt|h5|pkl|json|txt)$')
    AND filename NOT LIKE '%.meta.json')
WHERE rn = 1""",
    ),
)
def latest_checkpoint(spark, sf_dir):
    return ck.latest_checkpoint(_files(spark, sf_dir))


@query(
    "latest_by_framework",
    over(
        "ckpt",
        """
SELECT job_id, framework, tier, filename, step, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, framework
    ORDER BY ts DESC, step DESC, tier = 'L1' DESC, filename DESC) AS rn FROM ckpt)
WHERE rn = 1""",
    ),
)
def latest_by_framework(spark, sf_dir):
    rows = views.ckpt(spark, sf_dir).select("job_id", "framework", "tier", "filename", "step", "ts")
    return ck.latest_by_framework(rows)


@query(
    "infer_framework",
    over(
        "ckpt",
        r"""
SELECT job_id, tier, filename, CASE
  WHEN hint IN ('torch', 'pytorch') THEN 'pytorch'
  WHEN hint IN ('tf', 'tensorflow', 'keras') THEN 'tensorflow'
  WHEN hint IN ('sklearn', 'scikit', 'scikit-learn') THEN 'sklearn'
  WHEN hint IN ('xgb', 'xgboost') THEN 'xgboost' WHEN hint IN ('lgbm', 'lightgbm') THEN 'lightgbm'
  WHEN name LIKE '%.pt' THEN 'pytorch' WHEN name LIKE '%.h5' THEN 'tensorflow' WHEN name LIKE '%.pkl' THEN 'sklearn'
  WHEN name LIKE '%.json' THEN 'xgboost' WHEN name LIKE '%.txt' THEN 'lightgbm'
  WHEN starts_with(module, 'sklearn.') THEN 'sklearn' ELSE 'pytorch' END AS inferred
FROM (SELECT job_id, tier, filename,
  CASE step % 4 WHEN 0 THEN 'keras' WHEN 1 THEN 'lgbm' END AS hint,
  CASE WHEN step % 4 = 2 THEN 'weights.bin' ELSE lower(filename) END AS name,
  CASE WHEN has_sidecar THEN 'sklearn.svm' ELSE 'builtins' END AS module FROM ckpt)""",
    ),
)
def infer_framework(spark, sf_dir):
    step = F.col("step") % 4
    hint = F.when(step == 0, " Keras").when(step == 1, "lgbm")
    name = F.when(step == 2, "weights.bin").otherwise(F.col("filename"))
    module = F.when(F.col("has_sidecar"), "sklearn.svm").otherwise("builtins")
    rows = views.ckpt(spark, sf_dir)
    return rows.select(
        "job_id", "tier", "filename", ck.infer_framework(hint, name, module).alias("inferred")
    )


@query(
    "resolve_path",
    over(
        "ckpt",
        """
WITH req AS (SELECT job_id, step, tier, CASE WHEN tier = 'L1' AND has_sidecar THEN concat('/local/', job_id, '/', filename)
    WHEN tier = 'L1' THEN filename
    WHEN has_sidecar THEN concat('s3://other/checkpoints/', job_id, '/', filename)
    ELSE concat('checkpoints/', job_id, '/', filename) END AS path, filename, has_sidecar FROM ckpt)
SELECT job_id, step, tier, path,
  CASE WHEN tier = 'L1' AND has_sidecar THEN 'local' WHEN tier = 'L1' THEN 'name' WHEN has_sidecar THEN 'url' ELSE 'key' END AS kind,
  CASE WHEN tier = 'L1' AND has_sidecar THEN NULL WHEN tier = 'L2' AND has_sidecar THEN 'other' ELSE 'bucket' END AS bucket,
  CASE WHEN tier = 'L1' AND has_sidecar THEN NULL ELSE concat('checkpoints/', job_id, '/', filename) END AS key,
  filename AS local_name
FROM req""",
    ),
)
def resolve_path(spark, sf_dir):
    rows = views.ckpt(spark, sf_dir)
    job = F.col("job_id").cast("string")
    local = F.concat(F.lit("/local/"), job, F.lit("/"), F.col("filename"))
    key = F.concat(F.lit("checkpoints/"), job, F.lit("/"), F.col("filename"))
    path = (
        F.when((F.col("tier") == "L1") & F.col("has_sidecar"), local)
        .when(F.col("tier") == "L1", F.col("filename"))
        .when(F.col("has_sidecar"), F.concat(F.lit("s3://other/"), key))
        .otherwise(key)
    )
    here = rows.filter(F.col("tier") == "L1").select(local.alias("path"))
    requests = rows.select("job_id", "step", "tier", path.alias("path"))
    return ck.resolve_path(requests, here, "bucket")


@query(
    "save_record",
    over(
        "step_log",
        """
SELECT event_id, job_id, step, 0 AS epoch, concat('ckpt_0_', step) AS checkpoint_id, filename,
  concat(filename, '.meta.json') AS sidecar, concat('checkpoints/', job_id, '/', filename) AS s3_key
FROM (SELECT *, concat('ckpt_0_', step, CASE framework WHEN 'pytorch' THEN '.pt' WHEN 'tensorflow' THEN '.weights.h5'
    WHEN 'sklearn' THEN '.pkl' WHEN 'xgboost' THEN '.json' ELSE '.txt' END) AS filename FROM step_log)""",
    ),
)
def save_record(spark, sf_dir):
    rows = ck.save_record(views.step_log(spark, sf_dir))
    return rows.select(
        "event_id", "job_id", "step", "epoch", "checkpoint_id", "filename", "sidecar", "s3_key"
    )


@query(
    "current_records",
    over(
        "step_log",
        """
SELECT event_id, job_id, step, framework, epoch, ts FROM (
  SELECT event_id, job_id, CAST(step % 7 AS INT) AS step, framework, 0 AS epoch, ts,
    row_number() OVER (PARTITION BY job_id, step % 7, framework ORDER BY ts DESC, event_id DESC) AS rn
  FROM step_log) WHERE rn = 1""",
    ),
)
def current_records(spark, sf_dir):
    rows = views.step_log(spark, sf_dir).select(
        "event_id",
        "job_id",
        (F.col("step") % 7).alias("step"),
        "framework",
        F.lit(0).alias("epoch"),
        "ts",
    )
    return ck.current_records(rows)


_METADATA = """
SELECT job_id, 'running' AS status, last_checkpoint, last_epoch, last_step, current_machine, local, s3, created_at, updated_at FROM (
  SELECT job_id, arg_max(concat('ckpt_0_', step), (ts, step, filename)) AS last_checkpoint,
    CAST(arg_max(step % 3, (ts, step, filename)) AS INT) AS last_epoch,
    arg_max(step, (ts, step, filename)) AS last_step,
    arg_max(concat('machine', step % 4), (ts, step, filename)) AS current_machine,
    arg_max(concat('checkpoints/', job_id, '/', filename), (ts, step, filename)) FILTER (tier = 'L1') AS local,
    arg_max(concat('checkpoints/', job_id, '/', filename), (ts, step, filename)) FILTER (tier = 'L2') AS s3,
    min(ts) AS created_at, max(ts) AS updated_at
  FROM ckpt GROUP BY job_id)"""


@query(
    "job_metadata",
    over("ckpt", _METADATA),
)
def job_metadata(spark, sf_dir):
    files = _files(spark, sf_dir).withColumns(
        {"epoch": F.col("step") % 3, "machine": F.concat(F.lit("machine"), F.col("step") % 4)}
    )
    return ck.job_metadata(files).select(
        "job_id",
        "status",
        "last_checkpoint",
        "last_epoch",
        "last_step",
        "current_machine",
        F.col("checkpoint_paths.local").alias("local"),
        F.col("checkpoint_paths.s3").alias("s3"),
        "created_at",
        "updated_at",
    )


@query(
    "retention",
    over(
        "ckpt",
        """
SELECT job_id, tier, filename, step, ts, bytes, CASE WHEN rn <= 5 THEN 'keep' ELSE 'remove' END AS action FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, tier ORDER BY ts DESC, step DESC, filename DESC) AS rn FROM ckpt)""",
    ),
)
def retention(spark, sf_dir):
    return ck.retention(_files(spark, sf_dir))


@query(
    "cache_eviction",
    over(
        "ckpt",
        """
SELECT job_id, filename, step, ts, bytes, CAST(cached AS BIGINT) AS cached_bytes,
  CASE WHEN ts + INTERVAL 864000 SECOND < TIMESTAMP '2024-01-31 00:00:00' THEN 'ttl'
    WHEN cached > 100000 THEN 'size' END AS reason
FROM (SELECT *, sum(bytes) OVER (PARTITION BY job_id ORDER BY ts DESC, step DESC, filename DESC
    ROWS UNBOUNDED PRECEDING) AS cached FROM ckpt WHERE tier = 'L1')""",
    ),
)
def cache_eviction(spark, sf_dir):
    local = _files(spark, sf_dir).filter(F.col("tier") == "L1").drop("tier")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return ck.cache_eviction(local, now, 100_000, 864_000)


_CADENCE = """
WITH r AS (
  SELECT job_id, event_id, step, ts, ts AS last, step % 10 = 0 AS saved FROM step_log WHERE step = 1
  UNION ALL
  SELECT s.job_id, s.event_id, s.step, s.ts,
    CASE WHEN s.step % 10 = 0 OR s.ts - r.last >= INTERVAL 86400 SECOND THEN s.ts ELSE r.last END,
    s.step % 10 = 0 OR s.ts - r.last >= INTERVAL 86400 SECOND
  FROM r JOIN steps s ON s.job_id = r.job_id AND s.step = r.step + 1)
SELECT job_id, event_id, step, saved FROM r"""


@query(
    "checkpoint_cadence",
    over("step_log", "WITH steps AS MATERIALIZED (SELECT * FROM step_log)," + _CADENCE[6:], True),
)
def checkpoint_cadence(spark, sf_dir):
    rows = cadence.checkpoint_cadence(views.step_log(spark, sf_dir), 10, 86400)
    return rows.select("job_id", "event_id", "step", "saved")


@query(
    "checkpoint_cadence_by_time",
    over(
        "step_log",
        "WITH steps AS MATERIALIZED (SELECT * FROM step_log),"
        + _CADENCE[6:]
        .replace("s.step % 10 = 0 OR ", "")
        .replace("step % 10 = 0 AS saved", "false AS saved"),
        True,
    ),
)
def checkpoint_cadence_by_time(spark, sf_dir):
    rows = cadence.checkpoint_cadence(views.step_log(spark, sf_dir), None, 86400, block=16)
    return rows.select("job_id", "event_id", "step", "saved")


@query(
    "checkpoint_cadence_by_step",
    over("step_log", "SELECT job_id, event_id, step, step % 10 = 0 AS saved FROM step_log"),
)
def checkpoint_cadence_by_step(spark, sf_dir):
    rows = cadence.checkpoint_cadence(views.step_log(spark, sf_dir), 10)
    return rows.select("job_id", "event_id", "step", "saved")


@query(
    "artifact_key",
    over(
        "artifact_l1",
        """
SELECT job_id, name, regexp_replace(name, '^.*/', '') AS base_name,
  concat('artifacts/', job_id, '/', regexp_replace(name, '^.*/', '')) AS key FROM artifact_l1""",
    ),
)
def artifact_key(spark, sf_dir):
    return art.artifact_key(views.artifact_l1(spark, sf_dir).select("job_id", "name"))


@query(
    "load_artifacts",
    over(
        "artifact_l1 artifact_l2",
        """
WITH req AS (SELECT source AS job_id, concat(CASE doc_id % 6 WHEN 0 THEN 'ckpt_' ELSE 'doc_' END, doc_id,
    CASE doc_id % 4 WHEN 0 THEN '.pt' ELSE '.txt' END) AS name FROM documents)
SELECT q.job_id, q.name, CASE WHEN a.name IS NOT NULL THEN 'L1' WHEN b.name IS NOT NULL THEN 'L2' END AS source,
  coalesce(a.content, b.content) AS content,
  CASE WHEN a.name IS NULL AND b.name IS NULL THEN 'not_found' ELSE 'found' END AS status
FROM req q LEFT JOIN artifact_l1 a ON a.job_id = q.job_id AND a.name = concat('out/', q.name)
  LEFT JOIN artifact_l2 b ON b.job_id = q.job_id AND b.name = concat('out/', q.name)""",
    ),
)
def load_artifacts(spark, sf_dir):
    requests = views._artifact(spark, sf_dir, 1).select(
        "job_id", art.base_name("name").alias("name")
    )
    return art.load_artifacts(
        requests, views.artifact_l1(spark, sf_dir), views.artifact_l2(spark, sf_dir)
    )


_ART = """SELECT job_id, regexp_replace(name, '^.*/', '') AS name, saved_at, '{label}' AS source FROM {view}"""


@query(
    "list_artifacts",
    over(
        "artifact_l1 artifact_l2",
        f"""
SELECT *, concat('artifacts/', job_id, '/', name) AS path FROM (
  SELECT * FROM ({_ART.format(label="L1 (local)", view="artifact_l1")})
  WHERE NOT starts_with(name, 'ckpt_') AND name NOT LIKE '%.pt'
  UNION ALL {_ART.format(label="L2 (S3)", view="artifact_l2")})""",
    ),
)
def list_artifacts(spark, sf_dir):
    return art.list_artifacts(views.artifact_l1(spark, sf_dir), views.artifact_l2(spark, sf_dir))


@query(
    "list_artifacts_with_prefix",
    over(
        "artifact_l1 artifact_l2",
        f"""
SELECT *, concat('artifacts/', job_id, '/', name) AS path FROM (
  SELECT * FROM ({_ART.format(label="L1 (local)", view="artifact_l1")})
  WHERE NOT starts_with(name, 'ckpt_') AND name NOT LIKE '%.pt'
  UNION ALL {_ART.format(label="L2 (S3)", view="artifact_l2")}) WHERE starts_with(name, 'doc_1')""",
    ),
)
def list_artifacts_with_prefix(spark, sf_dir):
    l1, l2 = views.artifact_l1(spark, sf_dir), views.artifact_l2(spark, sf_dir)
    return art.list_artifacts(l1, l2, prefix="doc_1")
