"""Named queries: latency reports, formats and text records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as fm
from ..operators import latency as lt
from . import views
from .fixture_sql import over
from .registry import query

_SUMMARY = """round(avg({v}), 6) AS mean_ms, round(stddev_pop({v}), 6) AS stddev_ms,
  round(min({v}), 6) AS min_ms, round(max({v}), 6) AS max_ms"""
_STATS = ["mean_ms", "stddev_ms", "min_ms", "max_ms"]


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in _STATS})


@query(
    "latency_summary",
    over(
        "latency",
        f"SELECT name, {_SUMMARY.format(v='ms')}, count(*) AS iterations FROM latency GROUP BY name",
    ),
)
def latency_summary(spark, sf_dir):
    return _rounded(lt.latency_summary(views.latency(spark, sf_dir)))


@query(
    "latency_percentiles",
    over(
        "latency",
        """
SELECT name, p, round(quantile_cont(ms, p), 6) AS value FROM (
  SELECT name, ms, 0.5::DOUBLE AS p FROM latency) GROUP BY name, p
""".replace("quantile_cont(ms, p)", "quantile_cont(ms, 0.5)")
        + "".join(
            f"""
UNION ALL SELECT name, {p}::DOUBLE AS p, round(quantile_cont(ms, {p}), 6) AS value FROM latency GROUP BY name"""
            for p in (0.95, 0.99)
        ),
    ),
)
def latency_percentiles(spark, sf_dir):
    rows = lt.latency_percentiles(views.latency(spark, sf_dir), accuracy=100)
    return rows.withColumn("value", F.round("value", 6))


@query(
    "expiration_error",
    over(
        "lease_obs",
        f"""
SELECT device_id, {_SUMMARY.format(v="e")}, count(*) AS iterations
FROM (SELECT device_id, abs(actual_ms - duration_s * 1000)::DOUBLE AS e FROM lease_obs) GROUP BY device_id""",
    ),
)
def expiration_error(spark, sf_dir):
    return _rounded(lt.expiration_error(views.lease_obs(spark, sf_dir), ["device_id"]))


@query(
    "scalability",
    over(
        "latency",
        f"""
SELECT name, {_SUMMARY.format(v="per")}, count(*) AS levels FROM (
  SELECT name, level, sum(ms) / count(*) FILTER (ms < 200) AS per FROM latency
  GROUP BY name, level HAVING count(*) FILTER (ms < 200) > 0) GROUP BY name""",
    ),
)
def scalability(spark, sf_dir):
    return _rounded(lt.scalability(views.latency(spark, sf_dir), F.col("ms") < 200))


@query(
    "format_bytes",
    """
SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.2f B', s) WHEN s < 1024.0**2 THEN printf('%.2f KB', s / 1024)
  WHEN s < 1024.0**3 THEN printf('%.2f MB', s / 1024.0**2) WHEN s < 1024.0**4 THEN printf('%.2f GB', s / 1024.0**3)
  WHEN s < 1024.0**5 THEN printf('%.2f TB', s / 1024.0**4) ELSE printf('%.2f PB', s / 1024.0**5) END AS size
FROM (SELECT doc_id, n_chars::DOUBLE * pow(128::DOUBLE, doc_id % 7) AS s FROM documents)""",
)
def format_bytes(spark, sf_dir):
    size = F.col("n_chars") * F.pow(F.lit(128.0), F.col("doc_id") % 7)
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", fm.format_bytes(size).alias("size"))


@query(
    "format_duration",
    over(
        "lease",
        """
SELECT lease_id, CASE WHEN h > 0 THEN concat(h, 'h ', m, 'm ', s, 's') WHEN m > 0 THEN concat(m, 'm ', s, 's')
    ELSE concat(s, 's') END AS long_form,
  CASE WHEN duration_s < 60 THEN concat(duration_s, 's') WHEN duration_s < 3600 THEN concat(m, 'm ', s, 's')
    ELSE concat(h, 'h ', m, 'm') END AS short_form
FROM (SELECT lease_id, duration_s, CAST(trunc(duration_s / 3600) AS BIGINT) AS h,
  CAST(trunc((duration_s % 3600) / 60) AS BIGINT) AS m, duration_s % 60 AS s FROM lease)""",
    ),
)
def format_duration(spark, sf_dir):
    return views.lease(spark, sf_dir).select(
        "lease_id",
        fm.format_duration("duration_s").alias("long_form"),
        fm.format_duration("duration_s", "short").alias("short_form"),
    )


@query(
    "format_ts",
    over(
        "lease",
        """
SELECT lease_id, strftime(start_ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS human FROM lease""",
    ),
)
def format_ts(spark, sf_dir):
    return views.lease(spark, sf_dir).select(
        "lease_id",
        fm.format_ts("start_ts").alias("iso"),
        fm.format_ts("end_ts", human=True).alias("human"),
    )


@query(
    "parse_iso",
    over(
        "lease",
        """
SELECT lease_id, text, CASE WHEN lease_id % 5 <> 0 THEN date_trunc('second', start_ts) END AS parsed, lease_id % 5 <> 0 AS valid
FROM (SELECT *, CASE lease_id % 5 WHEN 0 THEN strftime(start_ts, '%d.%m.%Y %H:%M')
  ELSE strftime(start_ts, '%Y-%m-%dT%H:%M:%S') END AS text FROM lease)""",
    ),
)
def parse_iso(spark, sf_dir):
    german = F.regexp_replace(
        fm.format_ts("start_ts", human=True), r"^(\d+)-(\d+)-(\d+) (\d+:\d+).*$", "$3.$2.$1 $4"
    )
    text = F.when(F.col("lease_id") % 5 == 0, german).otherwise(fm.format_ts("start_ts"))
    rows = views.lease(spark, sf_dir).select("lease_id", text.alias("text"))
    return rows.withColumn("parsed", fm.parse_iso("text")).withColumn(
        "valid", F.col("parsed").isNotNull()
    )


@query(
    "extract_partition_id",
    over(
        "lock_text",
        r"""
SELECT lease_id, nullif(regexp_extract(text, '(?:^|\s)(partition_\S*)', 1), '') AS partition_id FROM lock_text""",
    ),
)
def extract_partition_id(spark, sf_dir):
    return views.lock_text(spark, sf_dir).select(
        "lease_id", fm.extract_partition_id("text").alias("partition_id")
    )


@query(
    "parse_device_lines",
    over(
        "device_text",
        """
SELECT CAST(device_id AS INT) AS id, CASE device_id % 2 WHEN 0 THEN 'Mock GPU' ELSE 'Mock host' END AS name,
  CASE device_id % 2 WHEN 0 THEN 'GPU' ELSE 'CPU' END AS type FROM device_text""",
    ),
)
def parse_device_lines(spark, sf_dir):
    return fm.parse_device_lines(views.device_text(spark, sf_dir))


@query(
    "parse_partition_lines",
    over(
        "lease",
        """
SELECT concat('partition_', lease_id) AS id, concat('gpu', device_id) AS device, 'active' AS status FROM lease""",
    ),
)
def parse_partition_lines(spark, sf_dir):
    text = F.concat(
        F.lit("Active partitions:\n-----------------\n  partition_"),
        F.col("lease_id"),
        F.lit(" gpu"),
        F.col("device_id"),
        F.lit(" 50%\nend of partition_ list\n"),
    )
    return fm.parse_partition_lines(views.lease(spark, sf_dir).select(text.alias("text")))


@query(
    "parse_lock_records",
    over(
        "lease",
        """
SELECT lease_id, lease_id + 100 AS pid, owner, CAST(device_id AS INT) AS device, fraction_pm,
  concat('partition_', lpad(CAST(lease_id AS VARCHAR), 6, '0')) AS partition_id FROM lease""",
    ),
)
def parse_lock_records(spark, sf_dir):
    return fm.parse_lock_records(views.lock_text(spark, sf_dir))


@query(
    "validate_rows",
    over(
        "config_rows",
        """
SELECT id, array_to_string(list_sort(list_filter([
  CASE WHEN s3_bucket IS NOT NULL AND (access_key IS NULL OR secret_key IS NULL)
    THEN 's3_credentials: S3 bucket specified but AWS credentials missing' END,
  CASE WHEN cache_size_limit_gb <= 0 THEN 'cache_size: Cache size limit must be positive' END,
  CASE WHEN keep_checkpoints <= 0 THEN 'keep_checkpoints: Keep checkpoints must be positive' END,
  CASE WHEN checkpoint_every_steps <= 0 THEN 'checkpoint_every_steps: Checkpoint every steps must be positive' END,
  CASE WHEN checkpoint_every_seconds <= 0 THEN 'checkpoint_every_seconds: Checkpoint every seconds must be positive' END
  ], lambda x: x IS NOT NULL)), '; ') AS errors FROM config_rows""",
    ),
)
def validate_rows(spark, sf_dir):
    rows = fm.validate_rows(views.config_rows(spark, sf_dir))
    shown = F.transform(F.map_entries("errors"), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return rows.select("id", F.array_join(F.array_sort(shown), "; ").alias("errors"))
