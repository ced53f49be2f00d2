"""Column expressions that format numbers and read report text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit names in steps of 1024.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
ISO_TEXT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
DEVICE_LINE = r"^Device (\d+): (.+)$"
PARTITION_LINE = r"^\s*(partition_\S+)\s+(\S+)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_bytes(size: Column | str) -> Column:
    """``1.50 KB``: the largest unit up to PB, two decimals, exact ties to even."""
    size = _col(size).cast("double")
    chain = F
    for i, unit in enumerate(BYTE_UNITS):
        shown = F.bround((size / float(1024**i)).cast("decimal(38,18)"), 2).cast("decimal(22,2)")
        text = F.concat(shown.cast("string"), F.lit(" " + unit))
        if i == len(BYTE_UNITS) - 1:
            return chain.otherwise(text)
        chain = chain.when(size < float(1024 ** (i + 1)), text)
    raise AssertionError


def format_duration(seconds: Column | str, style: str = "long") -> Column:
    """``long``: 1h 2m 3s, minutes shown with hours. ``short``: 1h 2m, 2m 3s or 3s."""
    s = _col(seconds)
    hours, minutes, secs = (F.call_function("div", s, F.lit(3600)), F.call_function("div", s % 3600, F.lit(60)), s % 60)

    def part(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(unit))

    if style == "long":
        return (
            F.when(hours > 0, F.concat_ws(" ", part(hours, "h"), part(minutes, "m"), part(secs, "s")))
            .when(minutes > 0, F.concat_ws(" ", part(minutes, "m"), part(secs, "s")))
            .otherwise(part(secs, "s"))
        )
    return (
        F.when(s < 60, part(s, "s"))
        .when(s < 3600, F.concat_ws(" ", part(minutes, "m"), part(secs, "s")))
        .otherwise(F.concat_ws(" ", part(hours, "h"), part(minutes, "m")))
    )


def parse_iso(text: Column | str, strict: bool = False) -> Column:
    """``YYYY-MM-DDThh:mm:ss`` to TIMESTAMP_NTZ; bad text is null, or an error when strict.

    Text after the seconds is ignored.
    """
    text = _col(text)
    parsed = F.nullif(F.regexp_extract(text, ISO_TEXT, 0), F.lit("")).try_cast("timestamp_ntz")
    if not strict:
        return parsed
    wrong = F.raise_error(F.concat(F.lit("expected YYYY-MM-DDThh:mm:ss, got: "), text))
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(wrong.cast("timestamp_ntz"))


def format_ts(ts: Column | str, human: bool = False) -> Column:
    """Whole seconds as ``YYYY-MM-DDThh:mm:ss``, or with a blank for the human form."""
    text = F.substring(_col(ts).cast("timestamp_ntz").cast("string"), 1, 19)
    return text if human else F.replace(text, F.lit(" "), F.lit("T"))


def extract_partition_id(text: Column | str) -> Column:
    """The first word that starts with ``partition_``, or null."""
    return F.nullif(F.regexp_extract(_col(text), r"(?:^|\s)(partition_\S*)", 1), F.lit(""))


def _lines(df: DataFrame, text: str) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.explode(F.split(text, "\n")).alias("line"))


def parse_device_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Report text to (id, name, type) rows."""
    found = _lines(df, text).filter(F.col("line").rlike(DEVICE_LINE))
    return found.select(
        F.regexp_extract("line", DEVICE_LINE, 1).cast("int").alias("id"),
        F.trim(F.regexp_extract("line", DEVICE_LINE, 2)).alias("name"),
        F.when(F.col("line").contains("GPU"), "GPU").otherwise("CPU").alias("type"),
    )


def parse_partition_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Listing text to (id, device, status) rows."""
    found = _lines(df, text).filter(F.col("line").rlike(PARTITION_LINE))
    return found.select(
        F.regexp_extract("line", PARTITION_LINE, 1).alias("id"),
        F.regexp_extract("line", PARTITION_LINE, 2).alias("device"),
        F.lit("active").alias("status"),
    )


def parse_lock_record(text: Column | str) -> Column:
    """``key: value`` lines to a map; of a repeated key the first line counts."""
    lines = F.filter(F.split(_col(text), "\n"), lambda line: line.contains(": "))
    keys = F.transform(lines, lambda line: F.substring_index(line, ": ", 1))
    firsts = F.filter(lines, lambda line, i: F.array_position(keys, F.substring_index(line, ": ", 1)) == i + 1)
    return F.map_from_entries(
        F.transform(
            firsts,
            lambda line: F.struct(
                F.substring_index(line, ": ", 1),
                F.substr(line, F.length(F.substring_index(line, ": ", 1)) + 3),
            ),
        )
    )


def parse_lock_records(df: DataFrame, text: str = "text") -> DataFrame:
    """Lock text to typed columns; the owner is the ``user`` line."""
    keep = [c for c in df.columns if c != text]
    fields = df.select(*keep, parse_lock_record(text).alias("m"))
    value = lambda name: F.try_element_at("m", F.lit(name))
    return fields.select(
        *keep,
        value("pid").try_cast("bigint").alias("pid"),
        value("user").alias("owner"),
        value("device").try_cast("int").alias("device"),
        value("fraction").try_cast("int").alias("fraction_pm"),
        value("partition").alias("partition_id"),
    )


def failed_rules(rules: Mapping[str, tuple[Column, str]]) -> Column:
    """Map of rule name to message for the rules whose condition holds; empty when valid."""
    entries = []
    for name, (broken, message) in rules.items():
        entries += [F.lit(name), F.when(broken, message)]
    return F.map_filter(F.create_map(*entries), lambda _, message: message.isNotNull())


def config_rules() -> dict[str, tuple[Column, str]]:
    """The rules of a checkpointing configuration row."""
    # Rule names and messages.
    positive = {
        "cache_size": ("cache_size_limit_gb", "Cache size limit must be positive"),
        "keep_checkpoints": ("keep_checkpoints", "Keep checkpoints must be positive"),
        "checkpoint_every_steps": ("checkpoint_every_steps", "Checkpoint every steps must be positive"),
        "checkpoint_every_seconds": (
            "checkpoint_every_seconds",
            "Checkpoint every seconds must be positive",
        ),
    }
    has_bucket = F.length(F.coalesce("s3_bucket", F.lit(""))) > 0
    no_keys = F.col("access_key").isNull() | F.col("secret_key").isNull()
    rules = {"s3_credentials": (has_bucket & no_keys, "S3 bucket specified but AWS credentials missing")}
    rules.update({name: (F.col(c) <= 0, message) for name, (c, message) in positive.items()})
    return rules


def validate_rows(df: DataFrame, rules: Mapping[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Adds ``errors``, the map of broken rules."""
    return df.withColumn("errors", failed_rules(config_rules() if rules is None else rules))
