"""Named queries: the lease log and the byte ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leases as ls
from ..operators import quota
from . import views
from .fixture_sql import over
from .registry import query
from .scratch import written

_NOW = "2024-01-15 12:00:00"


def _at():
    return F.lit(_NOW).cast("timestamp_ntz")


_T = f"TIMESTAMP '{_NOW}'"
_ACTIVE = f"start_ts <= {_T} AND {_T} < end_ts"


@query(
    "validate_leases",
    over(
        "lease device",
        """
SELECT l.*, CASE WHEN d.device_id IS NULL THEN 'device' WHEN NOT (fraction_pm BETWEEN 1 AND 1000) THEN 'fraction'
  WHEN NOT duration_s > 0 THEN 'duration' END AS reason
FROM (SELECT * REPLACE (lease_id % 9 AS device_id, CAST(fraction_pm * 2 AS INT) AS fraction_pm) FROM lease) l
LEFT JOIN device d ON d.device_id = l.device_id""",
    ),
)
def validate_leases(spark, sf_dir):
    asked = views.lease(spark, sf_dir).withColumns(
        {"device_id": F.col("lease_id") % 9, "fraction_pm": F.col("fraction_pm") * 2}
    )
    return ls.validate_leases(asked, views.device(spark, sf_dir))


@query("active_leases", over("lease", f"SELECT * FROM lease WHERE {_ACTIVE}"))
def active_leases(spark, sf_dir):
    return ls.active_leases(views.lease(spark, sf_dir), _at())


@query(
    "time_remaining",
    over(
        "lease",
        f"""
SELECT lease_id, duration_s, CASE WHEN {_ACTIVE} THEN
  greatest(0, duration_s - CAST(floor((epoch_us({_T}) - epoch_us(start_ts)) / 1e6) AS BIGINT)) ELSE 0 END AS remaining_s
FROM lease""",
    ),
)
def time_remaining(spark, sf_dir):
    rows = ls.time_remaining(views.lease(spark, sf_dir), _at())
    return rows.select("lease_id", "duration_s", "remaining_s")


@query(
    "expirations",
    over(
        "lease",
        f"""
SELECT lease_id, device_id, owner, end_ts AS expired_at FROM lease WHERE duration_s > 0 AND end_ts <= {_T}""",
    ),
)
def expirations(spark, sf_dir):
    return ls.expirations(views.lease(spark, sf_dir), _at())


_USAGE = """
WITH e AS (SELECT device_id, lease_id, start_ts AS "at", fraction_pm AS delta_pm FROM lease WHERE duration_s > 0
  UNION ALL SELECT device_id, lease_id, end_ts, -fraction_pm FROM lease WHERE duration_s > 0),
r AS (SELECT *, CAST(sum(delta_pm) OVER (PARTITION BY device_id ORDER BY "at", sign(delta_pm), lease_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_pm FROM e)"""


@query(
    "capacity_timeline",
    over(
        "lease device",
        _USAGE
        + """
SELECT r.device_id, lease_id, "at", delta_pm, used_pm, 1000 - used_pm AS available_pm,
  CAST(total_bytes * (1000 - used_pm) // 1000 AS BIGINT) AS available_bytes, (1000 - used_pm) / 10.0::DOUBLE AS available_pct
FROM r JOIN device d ON d.device_id = r.device_id""",
    ),
)
def capacity_timeline(spark, sf_dir):
    return ls.capacity_timeline(views.lease(spark, sf_dir), views.device(spark, sf_dir))


_STATS = f"""
SELECT d.device_id, name, total_bytes, CAST(total_bytes * coalesce(pm, 0) // 1000 AS BIGINT) AS used_bytes,
  CAST(total_bytes - total_bytes * coalesce(pm, 0) // 1000 AS BIGINT) AS available_bytes,
  coalesce(pm, 0) / 10.0::DOUBLE AS usage_pct, coalesce(n, 0) AS active_leases
FROM device d LEFT JOIN (SELECT device_id, CAST(sum(fraction_pm) AS BIGINT) AS pm, count(*) AS n
  FROM lease WHERE {_ACTIVE} GROUP BY device_id) a ON a.device_id = d.device_id"""


@query("device_stats", over("lease device", _STATS))
def device_stats(spark, sf_dir):
    return ls.device_stats(views.lease(spark, sf_dir), views.device(spark, sf_dir), _at())


@query(
    "overcommit_audit",
    over(
        "lease",
        _USAGE
        + """
SELECT device_id, lease_id, "at", delta_pm, used_pm FROM r WHERE delta_pm > 0 AND used_pm > 1000""",
    ),
)
def overcommit_audit(spark, sf_dir):
    return ls.overcommit_audit(views.lease(spark, sf_dir))


_PAIRS = """
SELECT a.lease_id AS held_id, b.lease_id, b.device_id, b.fraction_pm,
  CASE WHEN a.owner <> b.owner THEN 'denied' ELSE 'exists' END AS kind, b.owner, b.start_ts
FROM lease a JOIN lease b ON a.device_id = b.device_id AND a.fraction_pm = b.fraction_pm
  AND (a.start_ts, a.lease_id) < (b.start_ts, b.lease_id) AND b.start_ts < a.end_ts AND a.start_ts < b.end_ts
WHERE a.duration_s > 0 AND b.duration_s > 0"""


@query(
    "lock_conflicts",
    over(
        "lease",
        f"""
SELECT lease_id, device_id, fraction_pm, owner, start_ts, count(*) FILTER (kind = 'denied') AS held_by_other,
  count(*) FILTER (kind = 'exists') AS held_by_same,
  CASE WHEN count(*) FILTER (kind = 'denied') > 0 THEN 'denied' ELSE 'exists' END AS kind
FROM ({_PAIRS}) GROUP BY lease_id, device_id, fraction_pm, owner, start_ts""",
    ),
)
def lock_conflicts(spark, sf_dir):
    return ls.lock_conflicts(views.lease(spark, sf_dir))


@query(
    "lock_conflict_pairs",
    over("lease", f"SELECT held_id, lease_id, device_id, fraction_pm, kind FROM ({_PAIRS})"),
)
def lock_conflict_pairs(spark, sf_dir):
    return ls.lock_conflict_pairs(views.lease(spark, sf_dir))


@query(
    "release_authorization",
    over(
        "lease",
        """
WITH req AS (SELECT lease_id + 3 * (lease_id % 2) AS lease_id, owner AS requester,
  start_ts + INTERVAL 600 SECOND AS at FROM lease)
SELECT q.lease_id, q.requester, q.at, CASE WHEN NOT coalesce(l.start_ts <= q.at AND q.at < l.end_ts, false) THEN 'not_found'
  WHEN l.owner <> q.requester THEN 'denied' ELSE 'released' END AS verdict
FROM req q LEFT JOIN lease l ON l.lease_id = q.lease_id""",
    ),
)
def release_authorization(spark, sf_dir):
    rows = views.lease(spark, sf_dir)
    requests = rows.select(
        (F.col("lease_id") + 3 * (F.col("lease_id") % 2)).alias("lease_id"),
        F.col("owner").alias("requester"),
        F.timestamp_add("SECOND", F.lit(600), "start_ts").alias("at"),
    )
    return ls.release_authorization(requests, rows)


_QUOTA = """
WITH ops AS MATERIALIZED (SELECT o.*, t.size AS held, row_number() OVER (PARTITION BY o.key ORDER BY o.ts, o.event_id) AS rn
  FROM buffer_op o LEFT JOIN buffer_op t ON t.key = o.key AND t.buffer_id = o.buffer_id AND t.op = 'track'),
r AS (
  SELECT key, 0::BIGINT AS rn, NULL::BIGINT AS event_id, false AS ok, 0::BIGINT AS usage, []::BIGINT[] AS live
  FROM (SELECT DISTINCT key FROM ops)
  UNION ALL
  SELECT o.key, o.rn, o.event_id,
    CASE WHEN o.op = 'track' THEN r.usage + o.size <= o.limit_bytes ELSE coalesce(list_contains(r.live, o.buffer_id), false) END,
    CASE WHEN o.op = 'track' AND r.usage + o.size <= o.limit_bytes THEN r.usage + o.size
      WHEN o.op = 'release' AND coalesce(list_contains(r.live, o.buffer_id), false) THEN r.usage - o.held ELSE r.usage END,
    CASE WHEN o.op = 'track' AND r.usage + o.size <= o.limit_bytes THEN list_append(r.live, o.buffer_id)
      WHEN o.op = 'release' THEN list_filter(r.live, lambda b: b IS DISTINCT FROM o.buffer_id) ELSE r.live END
  FROM r JOIN ops o ON o.key = r.key AND o.rn = r.rn + 1)
SELECT event_id, key, ok, usage FROM r WHERE rn > 0"""


@query("quota_fold", over("buffer_op", _QUOTA, recursive=True))
def quota_fold(spark, sf_dir):
    ops = written(views.buffer_op(spark, sf_dir), "ops")
    return quota.quota_fold(ops).select("event_id", "key", "ok", "usage")


@query(
    "quota_fold_with_room",
    over("buffer_op", _QUOTA.replace("o.limit_bytes", "o.limit_bytes * 10"), recursive=True),
)
def quota_fold_with_room(spark, sf_dir):
    """Ten times the limit and a low size mark: many keys are summed in parallel."""
    ops = views.buffer_op(spark, sf_dir).withColumn("limit_bytes", F.col("limit_bytes") * 10)
    ops = written(ops, "ops")
    folded = quota.quota_fold(ops)
    return folded.select("event_id", "key", "ok", "usage")


@query(
    "availability_band",
    over(
        "lease device",
        f"""
SELECT *, 100.0::DOUBLE - usage_pct AS available_pct,
  CASE WHEN 100 - usage_pct >= 70 THEN 'green' WHEN 100 - usage_pct >= 30 THEN 'yellow' ELSE 'red' END AS band
FROM ({_STATS})""",
    ),
)
def availability_band(spark, sf_dir):
    stats = ls.device_stats(views.lease(spark, sf_dir), views.device(spark, sf_dir), _at())
    return ls.availability_band(stats)


@query(
    "assign_ids",
    over(
        "lease",
        """
SELECT lease_id, device_id, rn AS number, concat('partition_', CASE WHEN rn < 10000 THEN lpad(CAST(rn AS VARCHAR), 4, '0')
  ELSE CAST(rn AS VARCHAR) END) AS partition_id
FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY start_ts, lease_id) AS rn FROM lease)""",
    ),
)
def assign_ids(spark, sf_dir):
    rows = ls.assign_ids(views.lease(spark, sf_dir))
    return rows.select("lease_id", "device_id", "number", "partition_id")
