"""Time helpers: 14-digit stamps, ISO text, whole elapsed hours and days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

TS14 = "yyyyMMddHHmmss"
ISO = "yyyy-MM-dd HH:mm:ss"


def lit_ts(value: dt.datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal (no zone appears anywhere in the data).

    Built from ISO text so the session and process time zones never shift it.
    """
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def to_ts14(ts: Column) -> Column:
    return F.date_format(ts, TS14)


def from_ts14(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit(TS14))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def whole_hours(start: Column, end: Column) -> Column:
    """Whole elapsed hours from ``start`` to ``end`` (23 h 59 m -> 23)."""
    return F.timestamp_diff("HOUR", start, end)


def whole_days(start: Column, end: Column) -> Column:
    """Completed days from ``start`` to ``end`` (``find -mtime`` semantics)."""
    return F.timestamp_diff("DAY", start, end)

