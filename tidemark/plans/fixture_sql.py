"""DuckDB text of the input views, used as CTEs by the oracle queries."""

from __future__ import annotations

VIEWS = {
    "pairs": """
SELECT a.conv_id * 1000 + a.turn AS pair_id, a.conv_id, a.text AS cand, u.text AS ref
FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE a.role = 'assistant'""",
    "mcq": """
SELECT conv_id * 1000 + turn AS item_id, text AS generation,
  substr('ABCD', CAST((conv_id + turn) % 4 + 1 AS INT), 1) AS reference,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'mcq' WHEN 1 THEN 'mt' WHEN 2 THEN 'ssg' ELSE 'other' END AS task_type
FROM conversations""",
    "vec_pairs": """
SELECT g.vec_id AS pair_id, g.label, g.embedding AS gen_vec, r.embedding AS ref_vec
FROM embeddings g JOIN embeddings r ON r.vec_id = g.vec_id + 1 WHERE g.vec_id % 2 = 0""",
    "scores": """
SELECT vec_id AS item_id, embedding AS scores, substr('ABCD', label % 4 + 1, 1) AS reference FROM embeddings""",
    "vocab": """
SELECT CAST(id AS INT) AS token_id, chr(CAST(65 + id AS INT)) AS token
FROM (SELECT vec_id AS id FROM embeddings WHERE vec_id < 64)""",
    "token_lp": """
SELECT vec_id AS seq_id, pos - 1 AS pos, -abs(CAST(embedding[pos] AS DOUBLE)) AS logprob
FROM (SELECT vec_id, embedding, unnest(range(1, vec_id % 16 + 1)) AS pos FROM embeddings)""",
    "step_log": """
SELECT event_id, user_id AS job_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS step,
  CASE event_type WHEN 'click' THEN 'pytorch' WHEN 'view' THEN 'tensorflow' WHEN 'purchase' THEN 'sklearn'
    WHEN 'signup' THEN 'xgboost' ELSE 'lightgbm' END AS framework,
  ts, CAST(round(value * 100) AS BIGINT) AS bytes
FROM events""",
    "ckpt": """
SELECT s.job_id, s.step, s.framework, s.ts, s.bytes, t.tier, s.event_id % 5 <> 0 AS has_sidecar,
  concat('ckpt_0_', s.step, CASE s.framework WHEN 'pytorch' THEN '.pt' WHEN 'tensorflow' THEN '.weights.h5'
    WHEN 'sklearn' THEN '.pkl' WHEN 'xgboost' THEN '.json' ELSE '.txt' END) AS filename
FROM step_log s JOIN (SELECT 'L1' AS tier, 2 AS m UNION ALL SELECT 'L2' AS tier, 3 AS m) t ON s.event_id % t.m = 0""",
    "lease": """
SELECT event_id AS lease_id, user_id % 8 AS device_id, concat('user', user_id % 20) AS owner,
  CAST(50 + 50 * (event_id % 10) AS INT) AS fraction_pm, ts AS start_ts, duration_s,
  ts + to_seconds(duration_s) AS end_ts
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) - 50 AS duration_s FROM events)""",
    "lease_obs": """
SELECT *, duration_s * 1000 + lease_id % 100 - 50 AS actual_ms FROM lease""",
    "device": """
SELECT r.r_regionkey + 4 * b.k AS device_id, concat('Device ', r.r_name) AS name,
  CAST(8589934592 AS BIGINT) AS total_bytes
FROM region r CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) b WHERE r.r_regionkey < 4""",
    "job_event": """
SELECT event_id, user_id AS job_id, ts,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused'
    WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status
FROM events""",
    "submission": """
SELECT event_id, ts, event_id * 9 // 10 AS job_id, value / 300 AS gpu_memory, event_id % 7 - 1 AS duration
FROM events""",
    "buffer_op": """
SELECT event_id, user_id AS key, ts, CAST(20000 AS BIGINT) AS limit_bytes,
  CASE WHEN event_type = 'purchase' THEN 'release' ELSE 'track' END AS op,
  CASE WHEN event_type = 'purchase' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) ELSE event_id END AS buffer_id,
  CAST(round(value * 100) AS BIGINT) AS size
FROM events""",
    "latency": """
SELECT event_type AS name, user_id % 10 + 1 AS level, value AS ms FROM events""",
    "artifact_l1": """
SELECT source AS job_id, concat('out/', CASE doc_id % 6 WHEN 0 THEN 'ckpt_' ELSE 'doc_' END, doc_id,
  CASE doc_id % 4 WHEN 0 THEN '.pt' ELSE '.txt' END) AS name, text AS content, doc_id AS saved_at
FROM documents WHERE doc_id % 2 = 0""",
    "artifact_l2": """
SELECT source AS job_id, concat('out/', CASE doc_id % 6 WHEN 0 THEN 'ckpt_' ELSE 'doc_' END, doc_id,
  CASE doc_id % 4 WHEN 0 THEN '.pt' ELSE '.txt' END) AS name, text AS content, doc_id AS saved_at
FROM documents WHERE doc_id % 3 = 0""",
    "lock_text": """
SELECT lease_id, concat('pid: ', lease_id + 100, chr(10), 'user: ', owner, chr(10), 'device: ', device_id, chr(10),
  'fraction: ', fraction_pm, chr(10), 'partition: partition_', lpad(CAST(lease_id AS VARCHAR), 6, '0'), chr(10)) AS text
FROM lease""",
    "device_text": """
SELECT device_id, concat('Device statistics:', chr(10), 'Device ', device_id, ': ',
  CASE device_id % 2 WHEN 0 THEN 'Mock GPU' ELSE 'Mock host' END, chr(10), '  Memory:', chr(10)) AS text
FROM device""",
    "config_rows": """
SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'bucket' END AS s3_bucket,
  CASE WHEN c_nationkey % 3 = 0 THEN 'key' END AS access_key, CASE WHEN c_nationkey % 4 = 0 THEN 'secret' END AS secret_key,
  c_acctbal AS cache_size_limit_gb, c_nationkey - 3 AS keep_checkpoints,
  c_nationkey - 5 AS checkpoint_every_steps, c_nationkey - 10 AS checkpoint_every_seconds
FROM customer""",
}

NEEDS = {
    "ckpt": ["step_log"],
    "lease_obs": ["lease"],
    "lock_text": ["lease"],
    "device_text": ["device"],
}


def over(views: str, sql: str, recursive: bool = False) -> str:
    """``sql`` with the named views (and what they need) put in front as CTEs."""
    wanted: list[str] = []
    for name in views.split():
        wanted += [n for n in NEEDS.get(name, []) if n not in wanted]
        wanted += [name] if name not in wanted else []
    ctes = [f"{name} AS ({VIEWS[name]})" for name in wanted]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + ",\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
