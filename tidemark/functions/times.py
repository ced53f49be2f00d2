"""TIMESTAMP_NTZ arithmetic that does not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_SECONDS = 86400


def _ntz(ts: Column | str) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds with six decimals; an interval of NTZ values knows no zone."""
    return (_ntz(end) - _ntz(start)).cast("interval second").cast("decimal(20,6)")


def whole_seconds(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end, cut towards zero."""
    return seconds_between(start, end).cast("bigint")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of an NTZ value read as UTC."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (seconds_between(epoch, ts) * 1_000_000).cast("bigint")


def as_utc(ts: Column | str) -> Column:
    """The NTZ value read as UTC, for watermarks and timers."""
    return F.timestamp_micros(micros(ts))


def time_bucket(ts: Column | str, unit: str = "HOUR") -> Column:
    """Number of the calendar ``DAY`` or ``HOUR`` since 1970."""
    ts = _ntz(ts)
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    if unit == "DAY":
        return days
    if unit == "HOUR":
        return days * 24 + F.hour(ts)
    raise ValueError(f"unknown unit: {unit}")
