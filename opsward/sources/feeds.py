"""Feed registry: the warehouse feeds as data (keys, capture column, level, merge mode).

A feed's columns are whatever its source DataFrame carries (no transcribed
column lists); the registry only states what the generic operators need:
the upsert keys, the capture-time column, whether the feed is per instance or
per database, and how a batch is merged (keyed upsert or touch-last-seen).
Key lists are inferred from the leading export columns and the event-star key.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dated import upsert_dated
from ..operators.lineage import durable
from ..operators.upsert import merge_last_seen, touched_rows, upsert_into_path, write_partitions
from .files import optional_source


@dataclass(frozen=True)
class Feed:
    name: str
    keys: tuple[str, ...]
    time_col: str = "capture_timestamp"
    level: str = "database"            # "database" feeds carry dbname, "instance" feeds do not
    merge: str = "upsert"              # "upsert", "last_seen", or "dated" (by date, though the date is no key)
    partition_cols: tuple[str, ...] = field(default=("hostname", "capture_date"))  # must follow from the keys; "dated" feeds lie by date instead


KEY_INDEX = "_key_index"  # readers of the table skip folders that begin with an underscore
EVENT_KEY = ("appl_id", "activity_id", "uow_id")

# The fourteen feeds of the monitoring warehouse and their keys.
FEEDS: dict[str, Feed] = {f.name: f for f in [
    Feed("pkg_cache_stmt", ("dbname", "hostname", "capture_timestamp", "member", "executable_id")),
    Feed("table_cumul", ("tabname", "tabschema", "dbname", "hostname", "capture_timestamp", "member")),
    Feed("database_cumul", ("dbname", "hostname", "capture_timestamp", "member")),
    Feed("bp_cumul", ("bp_name", "dbname", "hostname", "capture_timestamp", "member")),
    Feed("connection_info", ("hostname", "instancename", "dbname", "client_wrkstnname", "client_hostname",
                             "client_applname", "client_ipaddr", "client_prdid", "system_auth_id",
                             "session_auth_id", "client_platform"), merge="last_seen", partition_cols=("hostname",)),
    Feed("dbcfg", ("hostname", "instancename", "dbname", "capture_timestamp", "name", "member")),
    Feed("dbmcfg", ("hostname", "instancename", "capture_timestamp", "name"), level="instance"),
    Feed("reg_variables", ("hostname", "instancename", "capture_timestamp", "reg_var_name", "dbpartitionnum"),
         level="instance"),
    Feed("dbsize_info", ("hostname", "instancename", "dbname", "capture_timestamp")),
    Feed("thr_viol_ev", ("dbname", "hostname", *EVENT_KEY), merge="dated", partition_cols=()),
    Feed("thr_activi_ev", ("dbname", "hostname", *EVENT_KEY), merge="dated", partition_cols=()),
    Feed("thr_activi_ev_metrics", ("dbname", "hostname", *EVENT_KEY), merge="dated", partition_cols=()),
    Feed("thr_activi_ev_stmt", ("dbname", "hostname", *EVENT_KEY), merge="dated", partition_cols=()),
    Feed("thr_activi_ev_vals", ("dbname", "hostname", *EVENT_KEY, "stmt_value_index"), merge="dated", partition_cols=()),
]}

def scan_slice(df: DataFrame, feed: Feed, hostname: str | None = None, dbname: str | None = None,
               instancename: str | None = None) -> DataFrame:
    """Keyed scan: equality filters on the identifying columns (pushed to the scan / pruned partitions)."""
    cond: Column = F.lit(True)
    if hostname is not None:
        cond = cond & (F.col("hostname") == hostname)
    if dbname is not None and feed.level == "database":
        cond = cond & (F.col("dbname") == dbname.upper())
    if instancename is not None and "instancename" in df.columns:
        cond = cond & (F.col("instancename") == instancename.lower())
    return df.where(cond)


def stamp(df: DataFrame, feed: Feed, hostname: str, instancename: str, dbname: str | None,
          capture: dt.datetime) -> DataFrame:
    """Prefix a live scan with literal host/instance/(db)/capture columns, identifiers folded."""
    cols = [F.lit(hostname).alias("hostname"), F.lit(instancename.lower()).alias("instancename")]
    if feed.level == "database":
        cols.append(F.lit((dbname or "").upper()).alias("dbname"))
    cols.append(F.lit(capture).cast("timestamp_ntz").alias(feed.time_col))
    names = {c for c in ("hostname", "instancename", "dbname", feed.time_col)}
    return df.select(*cols, *[c for c in df.columns if c not in names])


def load_batch(spark: SparkSession, feed: Feed, target_path: str, batch: DataFrame, seq_col: str | None = None) -> dict:
    """Apply one batch of a feed to its warehouse table on shared storage; only the partitions it touches are read.

    Feeds whose key holds the capture time are partitioned by its date. Event feeds are too, with an index of their keys beside the
    files, so that an event that is imported again meets its older self whatever day it lies in. The others are partitioned
    by parts of their key. Without ``seq_col`` the last row of a key wins."""
    if feed.merge == "dated":
        batch = batch.withColumn("capture_date", F.date_format(feed.time_col, "yyyy-MM-dd"))
        return upsert_dated(spark, target_path, f"{target_path}/{KEY_INDEX}", batch, list(feed.keys), "capture_date", seq_col)
    if "capture_date" in feed.partition_cols:
        if feed.time_col not in feed.keys:
            raise ValueError(f"{feed.name}: a date partition needs the capture time in the key")
        batch = batch.withColumn("capture_date", F.to_date(F.col(feed.time_col)))
    parts = list(feed.partition_cols)
    if feed.merge == "upsert":
        return upsert_into_path(spark, target_path, batch, list(feed.keys), seq_col, parts)
    if feed.merge == "last_seen":
        batch = durable(batch)
        target = touched_rows(optional_source(spark, target_path, batch.schema), batch, parts)
        return write_partitions(durable(merge_last_seen(target, batch, list(feed.keys), feed.time_col)), target_path, parts)
    raise ValueError(feed.merge)
