"""Checkpoint catalog: listings, latest, retention, eviction.

Files and sidecars are two tables keyed by (job_id, tier, filename); tier is
``L1`` (local) or ``L2`` (shared). A sidecar row carries the name of the data
file it describes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ranged_rank, ranged_sums

FILE_KEY = ["job_id", "tier", "filename"]

# Accepted names, extensions and module prefixes by framework.
ALIASES = {
    "pytorch": ["torch", "pytorch"],
    "tensorflow": ["tf", "tensorflow", "keras"],
    "sklearn": ["sklearn", "scikit", "scikit-learn"],
    "xgboost": ["xgb", "xgboost"],
    "lightgbm": ["lgbm", "lightgbm"],
}
EXTENSIONS = {
    "pytorch": ".pt",
    "tensorflow": ".h5",
    "sklearn": ".pkl",
    "xgboost": ".json",
    "lightgbm": ".txt",
}
SAVE_EXTENSIONS = {
    "pytorch": ".pt",
    "tensorflow": ".weights.h5",
    "sklearn": ".pkl",
    "xgboost": ".json",
    "lightgbm": ".txt",
}
MODULES = {
    "pytorch": ["torch."],
    "tensorflow": ["tensorflow.", "keras."],
    "sklearn": ["sklearn."],
    "xgboost": ["xgboost."],
    "lightgbm": ["lightgbm."],
}
SIDECAR_SUFFIX = ".meta.json"
TIER_LABELS = {"L1": "L1 (local)", "L2": "L2 (S3)"}


def _is_legacy(filename: Column, tier: Column) -> Column:
    return filename.endswith(".pt") & ((tier != "L1") | filename.startswith("ckpt_"))


def _tier_label(tier: Column) -> Column:
    return F.when(tier == "L1", TIER_LABELS["L1"]).when(tier == "L2", TIER_LABELS["L2"]).otherwise(tier)


def _stored_path() -> Column:
    job = F.col("job_id").cast("string")
    return F.concat_ws("/", F.lit("checkpoints"), job, F.col("filename"))


def list_checkpoints(sidecars: DataFrame, files: DataFrame, newest_first: bool = True) -> DataFrame:
    """Sidecar-first listing of both tiers.

    One full join answers both questions: a sidecar's file gives the timestamp
    (else the sidecar's own), and a file without a sidecar is listed only as a
    legacy ``.pt``. The key is a file name, so no key is hot. ``path`` is the file's own
    where the table of files has one, else its place below the job's checkpoints;
    ``metadata`` is what the sidecar says (null for a legacy file).
    """
    own_path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
    said = [c for c in sidecars.columns if c not in FILE_KEY]
    s = sidecars.select(
        *FILE_KEY,
        F.coalesce("epoch", F.lit(0)).alias("epoch"),
        F.coalesce("step", F.lit(0)).alias("step"),
        F.coalesce("framework", F.lit("unknown")).alias("framework"),
        F.col("ts").alias("__sidecar_ts"),
        F.lit(True).alias("__described"),
        F.to_json(F.struct(*[c for c in said if c != "ts"])).alias("metadata"),
    )
    f = files.filter(~F.col("filename").endswith(SIDECAR_SUFFIX)).select(
        *FILE_KEY, F.col("ts").alias("__file_ts"), own_path.alias("__path")
    )
    described = F.coalesce("__described", F.lit(False))
    listed = (
        s.join(f, FILE_KEY, "full_outer")
        .filter(described | _is_legacy(F.col("filename"), F.col("tier")))
        .select(
            *FILE_KEY,
            F.coalesce("epoch", F.lit(0)).alias("epoch"),
            F.coalesce("step", F.lit(0)).alias("step"),
            F.coalesce("framework", F.lit("pytorch")).alias("framework"),
            F.coalesce("__file_ts", "__sidecar_ts").alias("ts"),
            _tier_label(F.col("tier")).alias("source"),
            described.alias("has_sidecar"),
            F.coalesce("__path", _stored_path()).alias("path"),
            "metadata",
        )
    )
    return listed.orderBy(F.desc("ts"), *FILE_KEY) if newest_first else listed


def legacy_checkpoints(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """``.pt`` files without a sidecar, as epoch 0, step 0, pytorch."""
    return (
        files.filter(_is_legacy(F.col("filename"), F.col("tier")))
        .join(sidecars.select(*FILE_KEY), FILE_KEY, "left_anti")
        .select(
            *FILE_KEY,
            F.lit(0).alias("epoch"),
            F.lit(0).alias("step"),
            F.lit("pytorch").alias("framework"),
            "ts",
        )
    )


def _is_checkpoint(filename: Column) -> Column:
    known = F.lit(False)
    for ext in EXTENSIONS.values():
        known = known | filename.endswith(ext)
    return filename.startswith("ckpt_") & known & ~filename.endswith(SIDECAR_SUFFIX)


def _best_per(df: DataFrame, keys: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """The row with the greatest rank per key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("__best"))
    return best.select(*keys, "__best.*").select(*df.columns)


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """Newest data file of L1 if the job has any there, else the newest of L2."""
    valid = files.filter(_is_checkpoint(F.col("filename")))
    in_l1 = F.when(F.col("tier") == "L1", 1).otherwise(0)
    return _best_per(valid, ["job_id"], [in_l1, F.col("ts"), F.col("step"), F.col("filename")])


def latest_by_framework(listing: DataFrame) -> DataFrame:
    """Newest entry per job and framework over both tiers; equal copies prefer L1."""
    named = listing.withColumn("framework", F.lower("framework"))
    in_l1 = F.when(F.col("tier") == "L1", 1).otherwise(0)
    return _best_per(
        named, ["job_id", "framework"], [F.col("ts"), F.col("step"), in_l1, F.col("filename")]
    )


def infer_framework(hint: Column, filename: Column, module: Column | None = None) -> Column:
    """Framework by alias, else by extension, else by module prefix, else pytorch."""
    name = F.lower(F.trim(hint))
    base = F.lower(filename)
    chain = F
    for framework, aliases in ALIASES.items():
        chain = chain.when(name.isin(aliases), framework)
    for framework, ext in EXTENSIONS.items():
        chain = chain.when(base.endswith(ext), framework)
    if module is not None:
        for framework, prefixes in MODULES.items():
            for prefix in prefixes:
                chain = chain.when(module.startswith(prefix), framework)
    return chain.otherwise("pytorch")


def resolve_path(requests: DataFrame, local_paths: DataFrame, bucket: str) -> DataFrame:
    """Adds kind, bucket, key and local_name to requests (job_id, path).

    An existing local path is itself; ``s3://bucket/key`` is split; a bare name
    lies under the job's checkpoints; anything else is a key of ``bucket``.
    """
    known = local_paths.select(F.col("path"), F.lit(True).alias("__here")).distinct()
    path = F.col("path")
    url = r"^s3://([^/]+)/(.+)$"
    here = F.coalesce("__here", F.lit(False))
    kind = (
        F.when(here, "local")
        .when(path.startswith("s3://"), "url")
        .when(~path.contains("/"), "name")
        .otherwise("key")
    )
    key = (
        F.when(F.col("kind") == "url", F.regexp_extract(path, url, 2))
        .when(
            F.col("kind") == "name",
            F.concat(F.lit("checkpoints/"), F.col("job_id").cast("string"), F.lit("/"), path),
        )
        .when(F.col("kind") == "key", path)
    )
    return (
        requests.join(known, "path", "left")
        .withColumn("kind", kind)
        .select(
            *requests.columns,
            "kind",
            F.when(F.col("kind") == "url", F.regexp_extract(path, url, 1))
            .when(F.col("kind") != "local", F.lit(bucket))
            .alias("bucket"),
            key.alias("key"),
            F.regexp_replace(path, "^.*/", "").alias("local_name"),
        )
    )


def save_record(steps: DataFrame, epoch: Column | None = None) -> DataFrame:
    """What a save writes: id, file name, sidecar name and shared key per step row."""
    epoch = F.lit(0) if epoch is None else epoch
    ext = F
    for framework, suffix in SAVE_EXTENSIONS.items():
        ext = ext.when(F.col("framework") == framework, suffix)
    ident = F.concat_ws("_", F.lit("ckpt"), epoch.cast("string"), F.col("step").cast("string"))
    return (
        steps.withColumn("epoch", epoch)
        .withColumn("checkpoint_id", ident)
        .withColumn("filename", F.concat(ident, ext.otherwise(".pt")))
        .withColumn("sidecar", F.concat("filename", F.lit(SIDECAR_SUFFIX)))
        .withColumn(
            "s3_key", F.concat_ws("/", F.lit("checkpoints"), F.col("job_id").cast("string"), "filename")
        )
    )


def current_records(records: DataFrame) -> DataFrame:
    """A later save of the same (job, epoch, step, framework) replaces the earlier one."""
    return _best_per(records, ["job_id", "epoch", "step", "framework"], [F.col("ts"), F.col("event_id")])


def metadata_state(files: DataFrame) -> DataFrame:
    """One row per job with all that ``job_metadata`` shows, in a form that merges.

    ``checkpoint_id``, ``epoch`` and ``machine`` are taken from the files' own columns; without
    the first the id is the file name before its first dot, without the others they are
    0 and null.
    """

    def own(name: str, other: Column) -> Column:
        return (F.col(name) if name in files.columns else other).alias(name)

    ident = own("checkpoint_id", F.regexp_extract("filename", "^([^.]*)", 1))
    epoch = own("epoch", F.lit(0))
    machine = own("machine", F.lit(None).cast("string"))
    last = F.struct("ts", "step", "filename", ident, epoch, machine)
    path = _stored_path()
    in_tier = [F.when(F.col("tier") == t, F.struct(last.alias("at"), path.alias("path"))) for t in ("L1", "L2")]
    return files.groupBy("job_id").agg(
        F.max(last).alias("last"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.max(in_tier[0]).alias("local"),
        F.max(in_tier[1]).alias("shared"),
    )


def merge_metadata(states: DataFrame, *by: str) -> DataFrame:
    """States of the same job as one; the order and repeats of what is merged do not matter."""
    newest = [F.max(c).alias(c) for c in ("last", "updated_at", "local", "shared")]
    return states.groupBy("job_id", *by).agg(F.min("created_at").alias("created_at"), *newest)


def show_metadata(states: DataFrame) -> DataFrame:
    """What a reader sees of a job's state."""
    return states.select(
        "job_id",
        F.lit("running").alias("status"),
        F.col("last.checkpoint_id").alias("last_checkpoint"),
        F.col("last.epoch").alias("last_epoch"),
        F.col("last.step").alias("last_step"),
        F.col("last.machine").alias("current_machine"),
        F.struct(F.col("local.path").alias("local"), F.col("shared.path").alias("s3")).alias("checkpoint_paths"),
        "created_at",
        "updated_at",
    )


def job_metadata(files: DataFrame) -> DataFrame:
    """Last checkpoint and its paths per job; created is the first save, updated the last.

    The columns used are those of ``metadata_state``.
    """
    return show_metadata(metadata_state(files))


def retention(
    files: DataFrame,
    keep_last: int = 5,
    by: Sequence[str] = ("job_id", "tier"),
    ranges: int | None = None,
) -> DataFrame:
    """Adds ``action``: ``keep`` for the newest ``keep_last`` of each group, else ``remove``.

    Files are ranked inside sorted ranges, whatever the size of a group, and what earlier
    ranges hold is added from one count per range. Null jobs or tiers are groups too;
    files without a time come last.
    """
    order = [F.col(c) for c in ("ts", "step", "filename")]
    ranked = ranged_rank(files, list(by), order, "__rank", ranges, descending=True)
    kept = F.col("__rank") <= keep_last
    return ranked.withColumn("action", F.when(kept, "keep").otherwise("remove")).drop("__rank")


def cache_eviction(
    files: DataFrame,
    now: Column,
    cap_bytes: int = 10 * 1024**3,
    ttl_seconds: int = 86400,
    ranges: int | None = None,
) -> DataFrame:
    """Adds ``reason`` (``ttl``, ``size`` or null) over a job's cached files.

    Newest first until the cap is passed; a file older than the TTL goes anyway.
    """
    order = [F.col("ts"), F.col("step"), F.col("filename")]
    filled = ranged_sums(
        files, ["job_id"], order, {"cached_bytes": (F.col("bytes"), ())}, ranges, descending=True
    )
    stale = F.timestamp_add("SECOND", F.lit(ttl_seconds), "ts") < now
    return filled.withColumn(
        "reason", F.when(stale, "ttl").when(F.col("cached_bytes") > cap_bytes, "size")
    )
