"""Diagnostic-log records: blank-line separated, one header line with time and level.

    2024-01-05-10.11.12.123456 LEVEL: Error
    PID: E123  INSTANCE: nation7  DB: MACHINERY
    MESSAGE : text of the message

Read with ``lineSep='\\n\\n'`` so each record is one row and files split into
ordinary input partitions (no whole-file reads).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import clustered

TS_FORMAT = "yyyy-MM-dd-HH.mm.ss.SSSSSS"


def render_record(ts: Column, level: Column, rid: Column, instance: Column, db: Column, message: Column) -> Column:
    return F.concat(F.date_format(ts, TS_FORMAT), F.lit(" LEVEL: "), level, F.lit("\nPID: "), rid,
                    F.lit("  INSTANCE: "), instance, F.lit("  DB: "), db, F.lit("\nMESSAGE : "), message)


def write_log(records: DataFrame, path: str, record_col: str = "record", day_col: str | None = None) -> str:
    """Text records, in a folder per day if ``day_col`` is given."""
    # the text writer adds one newline; the extra one makes the blank separator line
    value = F.concat(F.col(record_col), F.lit("\n")).alias("value")
    if day_col is None:
        records.select(value).write.mode("overwrite").text(path)
    else:
        clustered(records.select(value, day_col), [day_col]).write.mode("overwrite").partitionBy(day_col).text(path)
    return path


def read_log(spark: SparkSession, path: str, day_col: str | None = None) -> DataFrame:
    """Parsed records; with ``day_col`` the folder's day comes along, so a filter on it prunes folders."""
    schema = "value string" + (f", {day_col} date" if day_col else "")
    raw = spark.read.schema(schema).text(path, lineSep="\n\n").where(F.trim(F.col("value")) != "")
    v = F.col("value")
    return raw.select(
        F.regexp_extract(v, r"PID: (\S+)", 1).alias("rid"),
        F.to_timestamp_ntz(F.regexp_extract(v, r"^\s*(\S+)", 1), F.lit(TS_FORMAT)).alias("ts"),
        F.regexp_extract(v, r"LEVEL: (\S+)", 1).alias("level"),
        F.regexp_extract(v, r"INSTANCE: (\S*)", 1).alias("instance"),
        F.regexp_extract(v, r"DB: (\S*)", 1).alias("db"),
        F.regexp_extract(v, r"(?s)MESSAGE : (.*)$", 1).alias("message"),
        *([day_col] if day_col else []),
    )
