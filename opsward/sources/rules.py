"""Colon-separated rule files.

Threshold file: ``host:instance:database:dow:kind:[warn;]crit``; exclusion lines
use ``excluded_table`` in the day-of-week slot and a comma list as value.
Availability file: ``host:instance:database:sensor:[warn;]crit``.
Leading blanks are stripped, ``#`` lines and blank lines skipped; matching is
case-insensitive, so host/instance/database are lower-cased here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(t: Column, i: int) -> Column:
    return F.trim(F.split_part(t, F.lit(":"), F.lit(i)))


def _content(lines: DataFrame) -> DataFrame:
    t = F.regexp_replace(F.col("line"), r"^[ \t]+", "")
    return (lines.select("file", "line_no", t.alias("t"))
            .where((F.col("t") != "") & ~F.col("t").startswith("#")))


def _split_threshold(value: Column, numeric: bool) -> tuple[Column, Column]:
    warn_txt = F.when(value.contains(";"), F.trim(F.split_part(value, F.lit(";"), F.lit(1)))).otherwise(F.lit("0"))
    crit_txt = F.when(value.contains(";"), F.trim(F.split_part(value, F.lit(";"), F.lit(2)))).otherwise(value)
    if numeric:
        return warn_txt.try_cast("int"), crit_txt.try_cast("int")
    return F.upper(warn_txt), F.upper(crit_txt)


def parse_threshold_rules(lines: DataFrame) -> DataFrame:
    """-> line_no, host, instance, dbname, dow, kind, warn_h, crit_h, excluded."""
    c = _content(lines)
    t = F.col("t")
    slot4 = _field(t, 4)
    is_excl = F.lower(slot4) == "excluded_table"
    value = _field(t, 6)
    warn, crit = _split_threshold(value, numeric=True)
    excluded = F.array_join(
        F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != ""), ",")
    return c.select(
        "file",
        "line_no",
        F.lower(_field(t, 1)).alias("host"),
        F.lower(_field(t, 2)).alias("instance"),
        F.lower(_field(t, 3)).alias("dbname"),
        F.when(is_excl, F.lit(None).cast("string")).otherwise(F.regexp_replace(slot4, r"\s+", "")).alias("dow"),
        F.lower(_field(t, 5)).alias("kind"),
        F.when(is_excl, F.lit(None).cast("int")).otherwise(warn).alias("warn_h"),
        F.when(is_excl, F.lit(None).cast("int")).otherwise(crit).alias("crit_h"),
        F.when(is_excl, excluded).alias("excluded"),
    )


def parse_availability_rules(lines: DataFrame) -> DataFrame:
    """-> line_no, host, instance, dbname, sensor, warn_state, crit_state."""
    c = _content(lines)
    t = F.col("t")
    warn, crit = _split_threshold(_field(t, 5), numeric=False)
    return c.select(
        "file",
        "line_no",
        F.lower(_field(t, 1)).alias("host"),
        F.lower(_field(t, 2)).alias("instance"),
        F.lower(_field(t, 3)).alias("dbname"),
        F.lower(_field(t, 4)).alias("sensor"),
        warn.alias("warn_state"),
        crit.alias("crit_state"),
    )


def parse_retention_rules(lines: DataFrame) -> DataFrame:
    """``host:instance:database:copies:extra`` — extra is ``+n`` (relative) or ``n`` (absolute)."""
    c = _content(lines)
    t = F.col("t")
    return c.select(
        "file",
        "line_no",
        F.lower(_field(t, 1)).alias("host"),
        F.lower(_field(t, 2)).alias("instance"),
        F.lower(_field(t, 3)).alias("dbname"),
        _field(t, 4).try_cast("int").alias("copies"),
        _field(t, 5).alias("extra"),
    )
