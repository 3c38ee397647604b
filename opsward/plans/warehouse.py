"""Monitoring-warehouse family: scans, sinks, upserts, streaming ingest, retention."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..functions.time import lit_ts, whole_days
from ..operators import retention as rt
from ..operators.upsert import dedupe_latest, merge_last_seen, upsert_into_path
from ..session import scratch_path
from ..sources.feeds import FEEDS, load_batch, scan_slice
from ..sources.files import (clustered, keys_from_path, optional_source, read_typed_csv, scan_by_key_pattern,
                             write_csv)
from ..sources.tables import table
from ..streaming.ingest import ingest_drop_folder
from .bindings import AS_OF_EVENTS_SQL, AS_OF_ORDERS_SQL, as_of_events, as_of_orders
from .registry import register

CUT_TARGET = "2024-01-20 00:00:00"     # target snapshot holds events before this
CUT_SOURCE = "2024-01-15 00:00:00"     # the incoming batch holds events from this on (overlap on purpose)
EVENT_KEYS = ["user_id", "event_type"]
ORDERS_DDL = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING")
LINEITEM_DDL = ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ")


def _events(spark, sf):
    return table(spark, sf, "events")


def _slices(spark, sf):
    ev = _events(spark, sf)
    return ev.where(F.col("ts") < lit_ts(CUT_TARGET)), ev.where(F.col("ts") >= lit_ts(CUT_SOURCE))


DEDUP_SQL = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) rn
  FROM events WHERE {cond}) WHERE rn = 1"""


# ------------------------------------------------------------------ S01/S05/S15
@register("scan_keyed_slice", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def q_scan_keyed_slice(spark, sf):
    """Fixed column list + key filter; both reach the parquet scan (ReadSchema / PushedFilters)."""
    o = table(spark, sf, "orders")
    return (o.where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"))
             .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))


@register("scan_stamped_snapshot", f"""
SELECT 'spark-host' AS hostname, 'inst1' AS instancename, 'TPCH' AS dbname, {AS_OF_ORDERS_SQL} AS capture_timestamp,
       c_custkey, c_name, c_nationkey, c_mktsegment FROM customer""")
def q_scan_stamped_snapshot(spark, sf):
    c = table(spark, sf, "customer")
    return (c.select(F.lit("spark-host").alias("hostname"), F.lit("inst1").alias("instancename"),
                     F.lit("TPCH").alias("dbname"), as_of_orders().alias("capture_timestamp"),
                     "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
             .orderBy("c_mktsegment", "c_custkey"))


@register("scan_optional_missing", "SELECT * FROM orders WHERE o_orderstatus = 'P'")
def q_scan_optional_missing(spark, sf):
    o = table(spark, sf, "orders")
    missing = optional_source(spark, scratch_path(spark, "never-written"), o.schema)
    return missing.unionByName(o.where(F.col("o_orderstatus") == "P"))


@register("scan_eav_config", """
SELECT user_id AS entity_id, ts AS capture_timestamp, 'k' AS name, json_extract_string(props, '$.k') AS value, 'INTEGER' AS datatype
FROM events
UNION ALL
SELECT user_id, ts, 'event_type', event_type, 'VARCHAR' FROM events""")
def q_scan_eav_config(spark, sf):
    """Config feed as long name/value rows that carry their own type name."""
    ev = _events(spark, sf)
    pairs = F.array(
        F.struct(F.lit("k").alias("name"), F.get_json_object("props", "$.k").alias("value"), F.lit("INTEGER").alias("datatype")),
        F.struct(F.lit("event_type").alias("name"), F.col("event_type").alias("value"), F.lit("VARCHAR").alias("datatype")))
    return ev.select(F.col("user_id").alias("entity_id"), F.col("ts").alias("capture_timestamp"),
                     F.explode(pairs).alias("p")).select("entity_id", "capture_timestamp", "p.*")


@register("scan_config_stamped", """
WITH c AS (SELECT event_id, 'host' || n_regionkey AS hostname, lower(n_name) AS instancename, upper(c_mktsegment) AS dbname, ts AS capture_timestamp,
                  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type
           FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT event_id, hostname, instancename, dbname, capture_timestamp, 'k' AS name, CAST(k AS VARCHAR) AS value,
             CASE WHEN k % 2 = 0 THEN 'AUTOMATIC' ELSE 'NONE' END AS value_flags, CAST(CASE WHEN k % 5 = 0 THEN k + 1 ELSE k END AS VARCHAR) AS deferred_value,
             CASE WHEN k % 3 = 0 THEN 'AUTOMATIC' ELSE 'NONE' END AS deferred_value_flags, 'BIGINT' AS datatype FROM c
      UNION ALL SELECT event_id, hostname, instancename, dbname, capture_timestamp, 'event_type', event_type, 'NONE', event_type, 'NONE', 'VARCHAR' FROM c)
SELECT *, TRY_CAST(CASE WHEN datatype = 'BIGINT' THEN value END AS BIGINT) AS number,
       value IS DISTINCT FROM deferred_value OR value_flags <> deferred_value_flags AS pending FROM l""")
def q_scan_config_stamped(spark, sf):
    """Config rows with host, instance, database and time, the flags of each value, the deferred value that a restart brings, the
    number by the row's own type, and whether a change is pending."""
    ev, c, n = table(spark, sf, "events"), table(spark, sf, "customer"), table(spark, sf, "nation")
    k = F.get_json_object("props", "$.k").cast("long")
    flag = lambda every: F.when(k % every == 0, F.lit("AUTOMATIC")).otherwise(F.lit("NONE"))
    pair = lambda name, value, flags, later, later_flags, kind: F.struct(
        F.lit(name).alias("name"), value.alias("value"), flags.alias("value_flags"), later.alias("deferred_value"),
        later_flags.alias("deferred_value_flags"), F.lit(kind).alias("datatype"))
    none, kind = F.lit("NONE"), F.col("event_type")
    pairs = F.array(pair("k", k.cast("string"), flag(2), F.when(k % 5 == 0, k + 1).otherwise(k).cast("string"), flag(3), "BIGINT"),
                    pair("event_type", kind, none, kind, none, "VARCHAR"))
    long = (ev.join(c, ev.user_id == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select("event_id", F.concat(F.lit("host"), F.col("n_regionkey").cast("string")).alias("hostname"), F.lower("n_name").alias("instancename"),
                    F.upper("c_mktsegment").alias("dbname"), F.col("ts").alias("capture_timestamp"), F.explode(pairs).alias("p")).select("*", "p.*").drop("p"))
    return long.select("*", F.when(F.col("datatype") == "BIGINT", F.col("value")).try_cast("long").alias("number"),
                       (~F.col("value").eqNullSafe(F.col("deferred_value")) | (F.col("value_flags") != F.col("deferred_value_flags"))).alias("pending"))


# ------------------------------------------------------------------ file sources / sinks
@register("scan_typed_csv", "SELECT * FROM orders")
def q_scan_typed_csv(spark, sf):
    path = write_csv(table(spark, sf, "orders"), scratch_path(spark, "orders-csv"))
    df = read_typed_csv(spark, path, ORDERS_DDL)
    return df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


@register("sink_csv_roundtrip", "SELECT * FROM lineitem")
def q_sink_csv_roundtrip(spark, sf):
    path = write_csv(table(spark, sf, "lineitem"), scratch_path(spark, "lineitem-csv"))
    return read_typed_csv(spark, path, LINEITEM_DDL, corrupt_col=None)


@register("load_outcome_per_file", """
SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice <= 400000) AS rows_loaded,
       count(*) FILTER (WHERE o_totalprice > 400000) AS rows_rejected
FROM orders GROUP BY o_orderstatus""")
def q_load_outcome_per_file(spark, sf):
    """All drop files in one read; per-file outcome by grouping on the file's partition folder."""
    o = table(spark, sf, "orders")
    # very large orders carry a malformed customer key in the drop files -> rejected rows
    bad = o.withColumn("o_custkey", F.when(F.col("o_totalprice") > 400000,
                                           F.concat(F.lit("X"), F.col("o_custkey").cast("string")))
                       .otherwise(F.col("o_custkey").cast("string")))
    path = write_csv(bad, scratch_path(spark, "drop-csv"), partition_by=["o_orderstatus"])
    ddl = ORDERS_DDL.replace("o_orderstatus STRING, ", "")
    df = read_typed_csv(spark, path, ddl)
    status = F.regexp_extract(F.col("_metadata.file_path"), r"o_orderstatus=([^/]+)/", 1)
    rejected = F.col("_corrupt_record").isNotNull()
    # every declared column is referenced, so the parser validates all of them (no pruning)
    whole = F.struct(*[F.col(c) for c in df.columns if c != "_corrupt_record"])
    return (df.select(status.alias("o_orderstatus"), rejected.alias("rej"), whole.alias("row"))
              .groupBy("o_orderstatus")
              .agg(F.count(F.when(~F.col("rej"), F.col("row"))).alias("rows_loaded"),
                   F.count(F.when(F.col("rej"), 1)).alias("rows_rejected")))


@register("load_rejects", """
SELECT o_orderstatus, o_orderkey, 'X' || o_custkey AS bad_value FROM orders WHERE o_totalprice > 400000""")
def q_load_rejects(spark, sf):
    """The reject table of the load: file key, and what the malformed row said; good rows of the file are loaded."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    bad = o.withColumn("o_custkey", F.when(F.col("o_totalprice") > 400000, F.concat(F.lit("X"), F.col("o_custkey").cast("string")))
                       .otherwise(F.col("o_custkey").cast("string")))
    path = write_csv(bad, scratch_path(spark, "drop-rejects"), partition_by=["o_orderstatus"])
    df = read_typed_csv(spark, path, "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE")
    raw = F.split("_corrupt_record", ",")
    # the columns are referenced, so the parser checks them
    return (df.where(F.col("_corrupt_record").isNotNull() & (F.col("o_orderkey").isNull() | F.col("o_custkey").isNull() | F.col("o_totalprice").isNull()))
            .select(F.regexp_extract(F.col("_metadata.file_path"), r"o_orderstatus=([^/]+)/", 1).alias("o_orderstatus"), "_corrupt_record")
            .select("o_orderstatus", raw[0].cast("long").alias("o_orderkey"), raw[1].alias("bad_value")))


@register("sink_export_roundtrip", """
SELECT * FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'""")
def q_sink_export_roundtrip(spark, sf):
    """Per-feed file set, overwritten per partition: the second export replaces only partition P."""
    o = table(spark, sf, "orders")
    path = scratch_path(spark, "orders-export")
    clustered(o, ["o_orderstatus"]).write.mode("overwrite").partitionBy("o_orderstatus").parquet(path)
    newer = o.where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") >= lit_ts("1998-01-01 00:00:00")))
    (clustered(newer, ["o_orderstatus"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("o_orderstatus").parquet(path))
    back = spark.read.schema(o.schema).parquet(path)
    return back.select(*o.columns)


@register("snapshot_append", f"""
SELECT r.r_name AS region, count(*) AS n_orders, 'spark-host' AS snap_server,
       CAST(s.ts AS DATE) AS snap_date, strftime(s.ts, '%H:%M:%S') AS snap_time, s.ts AS snap_ts
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
     JOIN region r ON n.n_regionkey = r.r_regionkey,
     (VALUES (TIMESTAMP '2001-06-01 06:30:00'), ({AS_OF_ORDERS_SQL})) s(ts)
WHERE o.o_orderdate < s.ts
GROUP BY r.r_name, s.ts""")
def q_snapshot_append(spark, sf):
    """Two snapshots of a monitoring view appended with server/date/time/timestamp stamps."""
    path = scratch_path(spark, "snap-hist")
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    base = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey))
    for stamp in ("2001-06-01 06:30:00", "2001-12-01 00:00:00"):
        ts = lit_ts(stamp)
        snap = (base.where(F.col("o_orderdate") < ts).groupBy(F.col("r_name").alias("region"))
                .agg(F.count(F.lit(1)).alias("n_orders"))
                .select("*", F.lit("spark-host").alias("snap_server"), F.to_date(ts).alias("snap_date"),
                        F.date_format(ts, "HH:mm:ss").alias("snap_time"), ts.alias("snap_ts")))
        snap.write.mode("append").parquet(path)
    return spark.read.parquet(path)


PUBLISH_FEEDS = {"orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey",
                 "part": "p_partkey", "lineitem": "l_orderkey"}


@register("publish_json_docs", " UNION ALL ".join(
    f"SELECT '{t}' AS feed, count(*) AS docs, CAST(sum({k}) AS BIGINT) AS key_sum FROM {t}"
    for t, k in PUBLISH_FEEDS.items()))
def q_publish_json_docs(spark, sf):
    """Each feed as JSON documents (one per row) on shared storage, and the report read back from the documents."""
    base = scratch_path(spark, "publish")
    out = None
    for t, key in PUBLISH_FEEDS.items():
        df = table(spark, sf, t)
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(f"{base}/{t}")
        back = spark.read.text(f"{base}/{t}").select(F.get_json_object("value", f"$.{key}").cast("long").alias("k"))
        one = back.agg(F.count(F.lit(1)).alias("docs"), F.sum("k").alias("key_sum")).select(F.lit(t).alias("feed"), "docs", "key_sum")
        out = one if out is None else out.unionByName(one)
    return out


@register("scan_files_by_key", "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'")
def q_scan_files_by_key(spark, sf):
    """Drop folder laid out by key; scan ``status=*/priority=1-URGENT`` (any part may be a wildcard)."""
    o = table(spark, sf, "orders")
    base = scratch_path(spark, "drop-keyed")
    clustered(o, ["o_orderstatus", "o_orderpriority"]).write.partitionBy("o_orderstatus", "o_orderpriority").parquet(base)
    df = scan_by_key_pattern(spark, base, [("o_orderstatus", None), ("o_orderpriority", "1-URGENT")], o.schema)
    return df.select(*o.columns)


@register("keys_from_path", """
SELECT replace(lower(r.r_name), ' ', '') AS host, lower(replace(n.n_name, '_', '')) AS instance,
       upper(c.c_mktsegment) AS dbname, 'customer' AS feed, count(*) AS n_rows
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY ALL""")
def q_keys_from_path(spark, sf):
    """Files named ``<host>_<instance>_<db>_<feed>``; keys come back from the path alone."""
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    named = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
              .select("c_custkey", F.concat_ws("_", F.regexp_replace(F.lower("r_name"), " ", ""),
                                               F.lower(F.regexp_replace("n_name", "_", "")),
                                               F.upper("c_mktsegment"), F.lit("customer")).alias("file_key")))
    base = scratch_path(spark, "drop-named")
    clustered(named, ["file_key"]).write.partitionBy("file_key").parquet(base)
    df = spark.read.schema("c_custkey BIGINT").parquet(f"{base}/*")
    k = keys_from_path(df, r"file_key=([^_/]+)_([^_/]+)_([^_/]+)_([^_/]+)/", ["host", "instance", "dbname", "feed"])
    return k.groupBy("host", "instance", "dbname", "feed").agg(F.count(F.lit(1)).alias("n_rows"))


@register("next_snapshot_version", """
SELECT day, day || '_' || CASE WHEN max(nn) IS NULL THEN '00' WHEN max(nn) + 1 > 99 THEN CAST(max(nn) + 1 AS VARCHAR) ELSE lpad(CAST(max(nn) + 1 AS VARCHAR), 2, '0') END AS next_folder
FROM (SELECT strftime(o_orderdate, '%Y') || '0101' AS day, (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) * 26 AS nn FROM orders
      UNION ALL SELECT DISTINCT strftime(o_orderdate, '%Y') || '0102', NULL::INTEGER FROM orders)
GROUP BY day""")
def q_next_snapshot_version(spark, sf):
    """Snapshot folders ``<yyyymmdd>_<nn>`` listed from storage; next nn = max + 1, 00 for a day without any."""
    o = table(spark, sf, "orders")
    base = scratch_path(spark, "snapshots")
    # up to 104 versions a day: numbers of two and of three digits
    nn = (F.substring("o_orderpriority", 1, 1).cast("int") - 1) * 26
    snap = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("0101_"), F.lpad(nn.cast("string"), F.greatest(F.length(nn.cast("string")), F.lit(2)), F.lit("0")))
    clustered(o.select("o_orderkey", snap.alias("snap")), ["snap"]).write.partitionBy("snap").parquet(base)
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
               .select(F.regexp_extract("path", r"snap=([^/]+)/", 1).alias("folder")).distinct())
    days = o.select(F.explode(F.array(*[F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(d)) for d in ("0101", "0102")])).alias("day"))
    return rt.next_version(listing, days=days)


# ------------------------------------------------------------------ upserts
def _bucketed(df):
    """A partition column that follows from the key, so a batch reads and rewrites its buckets only."""
    return df.withColumn("bucket", (F.col("user_id") % 16).cast("int"))


@register("upsert_keyed", f"""
WITH tgt AS ({DEDUP_SQL.format(cond=f"ts < TIMESTAMP '{CUT_TARGET}'")}),
     src AS ({DEDUP_SQL.format(cond=f"ts >= TIMESTAMP '{CUT_SOURCE}'")})
SELECT * FROM tgt WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.user_id = tgt.user_id AND src.event_type = tgt.event_type)
UNION ALL SELECT * FROM src""")
def q_upsert_keyed(spark, sf):
    """Keyed INSERT_UPDATE of a batch into a partitioned table on shared storage."""
    old, new = _slices(spark, sf)
    path = scratch_path(spark, "wh-events")
    clustered(dedupe_latest(_bucketed(old), EVENT_KEYS, "event_id"), ["bucket"]).write.partitionBy("bucket").parquet(path)
    upsert_into_path(spark, path, _bucketed(new), EVENT_KEYS, "event_id", ["bucket"])
    return spark.read.parquet(path).select(*_events(spark, sf).columns)


def _tagged(df):
    tag = F.when(F.col("value") >= 100, F.floor(F.col("value") / 100).cast("int"))
    return df.select("user_id", "event_type", tag.alias("tag"), "ts")


TAG_SQL = "CASE WHEN value >= 100 THEN CAST(floor(value / 100) AS INTEGER) END"


@register("merge_last_seen", f"""
WITH t AS (SELECT user_id, event_type, {TAG_SQL} AS tag, min(ts) AS first_seen, max(ts) AS last_seen
           FROM events WHERE ts < TIMESTAMP '{CUT_TARGET}' GROUP BY ALL),
     s AS (SELECT user_id, event_type, {TAG_SQL} AS tag, min(ts) AS first_seen, max(ts) AS last_seen
           FROM events WHERE ts >= TIMESTAMP '{CUT_SOURCE}' GROUP BY ALL)
SELECT coalesce(t.user_id, s.user_id) AS user_id, coalesce(t.event_type, s.event_type) AS event_type,
       CASE WHEN t.user_id IS NULL THEN s.tag ELSE t.tag END AS tag,
       coalesce(t.first_seen, s.first_seen) AS first_seen, coalesce(s.last_seen, t.last_seen) AS last_seen
FROM t FULL OUTER JOIN s ON t.user_id = s.user_id AND t.event_type = s.event_type AND t.tag IS NOT DISTINCT FROM s.tag""")
def q_merge_last_seen(spark, sf):
    """Touch-last-seen: 3 keys (one nullable, matched NULL-safe); only the stamp moves on a match."""
    old, new = _slices(spark, sf)
    keys = ["user_id", "event_type", "tag"]
    t = _tagged(old).groupBy(*keys).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    s = _tagged(new).groupBy(*keys).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return merge_last_seen(t, s, keys, "last_seen")


@register("join_null_safe", f"""
WITH a AS (SELECT user_id, event_type, {TAG_SQL} AS tag, count(*) AS n_before FROM events WHERE ts < TIMESTAMP '{CUT_TARGET}' GROUP BY ALL),
     b AS (SELECT user_id, event_type, {TAG_SQL} AS tag, count(*) AS n_after FROM events WHERE ts >= TIMESTAMP '{CUT_SOURCE}' GROUP BY ALL)
SELECT a.user_id, a.event_type, a.tag, a.n_before, b.n_after
FROM a JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.tag IS NOT DISTINCT FROM b.tag""")
def q_join_null_safe(spark, sf):
    old, new = _slices(spark, sf)
    keys = ["user_id", "event_type", "tag"]
    a = _tagged(old).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_before"))
    b = _tagged(new).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_after"))
    b2 = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys], "n_after")
    cond = (a.user_id.eqNullSafe(b2._b_user_id) & a.event_type.eqNullSafe(b2._b_event_type)
            & a.tag.eqNullSafe(b2._b_tag))
    return a.join(b2, cond, "inner").select(*keys, "n_before", "n_after")


@register("stream_ingest_upsert", DEDUP_SQL.format(cond="TRUE"))
def q_stream_ingest_upsert(spark, sf):
    """Drop folder drained by a file stream; every micro-batch upserts the keyed target."""
    ev = _events(spark, sf)
    drop = scratch_path(spark, "drop-stream")
    _bucketed(ev).repartition(6, "bucket").write.parquet(drop)
    target = scratch_path(spark, "stream-target")
    ingest_drop_folder(spark, drop, _bucketed(ev).schema, target, scratch_path(spark, "stream-ckpt"),
                       EVENT_KEYS, "event_id", ["bucket"], max_files_per_trigger=2, guard="newest")
    return spark.read.parquet(target).select(*ev.columns)


@register("upsert_null_partition", f"""
WITH t AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS part, c_acctbal FROM customer WHERE c_custkey % 3 <> 0),
     s AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS part, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM s UNION ALL SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM s)""")
def q_upsert_null_partition(spark, sf):
    """Rows of the null partition survive a batch that touches it."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("part"), "c_acctbal")
    path = scratch_path(spark, "null-part")
    clustered(c.where("c_custkey % 3 <> 0"), ["part"]).write.partitionBy("part").parquet(path)
    new = c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    upsert_into_path(spark, path, new, ["c_custkey"], None, ["part"])
    return spark.read.schema(c.schema).parquet(path).select(*c.columns)


@register("upsert_batch_duplicates", """
SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def q_upsert_batch_duplicates(spark, sf):
    """Several rows of one key in a batch, some without a sequence: one row per key stays, the last by sequence."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "value")
    blank = ev.where("event_id % 5 = 0").withColumns({"event_id": F.lit(None).cast(ev.schema["event_id"].dataType), "value": F.lit(-1.0)})
    path = scratch_path(spark, "batch-dup")
    upsert_into_path(spark, path, _bucketed(ev.unionByName(blank)), ["user_id"], "event_id", ["bucket"])
    return spark.read.parquet(path).select("user_id", "event_id", "value")


def _feed_base(spark, sf):
    """The events with host, instance and database of their entity, which all feeds are made of."""
    ev, c, n = table(spark, sf, "events"), table(spark, sf, "customer"), table(spark, sf, "nation")
    return (ev.join(c, ev.user_id == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select(F.concat(F.lit("host"), F.col("n_regionkey").cast("string")).alias("hostname"), F.lower("n_name").alias("instancename"),
                    F.upper("c_mktsegment").alias("dbname"), F.date_trunc("WEEK", "ts").alias("_time"), "user_id", "event_type", "value", "event_id"))


def _stored_base(spark, sf):
    path = scratch_path(spark, "feed-base")
    _feed_base(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def _feed_rows(spark, sf, feed, base=None):
    """Rows for a feed: the base and the feed's own key columns."""
    base = (_feed_base(spark, sf) if base is None else base).withColumnRenamed("_time", feed.time_col)
    own = [k for k in feed.keys if k not in base.columns]
    return base.withColumns({k: F.concat(F.lit(f"{k}-"), (F.col("user_id") % (7 + 3 * i)).cast("string")) for i, k in enumerate(own)})


def _feed_key_sql(feed):
    have = {"hostname": "'host' || n_regionkey", "instancename": "lower(n_name)", "dbname": "upper(c_mktsegment)", "capture_timestamp": "date_trunc('week', ts)"}
    own = [k for k in feed.keys if k not in have]
    return ", ".join(have.get(k) or f"'{k}-' || user_id % {7 + 3 * own.index(k)}" for k in feed.keys)


LOADED_FEEDS = tuple(FEEDS)
LOADS_AT_ONCE = 4
IMPORTED_AGAIN = ("database_cumul", "connection_info", "dbcfg", "thr_viol_ev")


def _loaded(spark, sf, names) -> dict:
    """Loads feeds side by side from one stored base; the folder of each."""
    base = _stored_base(spark, sf)
    paths = {name: scratch_path(spark, f"feed-{name}") for name in names}

    def load(name):
        feed = FEEDS[name]
        rows = _feed_rows(spark, sf, feed, base)
        for part in ["event_id % 3 <> 0", "event_id % 3 <> 1"] if name in IMPORTED_AGAIN else ["true"]:
            load_batch(spark, feed, paths[name], rows.where(part), None if feed.merge == "last_seen" else "event_id")

    with ThreadPoolExecutor(LOADS_AT_ONCE) as pool:
        list(pool.map(load, names))
    return paths


VALUE_FEEDS = ("database_cumul", "dbcfg", "thr_viol_ev", "dbmcfg")


@register("feeds_values", " UNION ALL ".join(f"""
SELECT '{f}' AS feed, hostname, instancename, dbname, capture_timestamp, event_id, value FROM (
  SELECT 'host' || n_regionkey AS hostname, lower(n_name) AS instancename, upper(c_mktsegment) AS dbname, date_trunc('week', ts) AS capture_timestamp, event_id, value,
         row_number() OVER (PARTITION BY {_feed_key_sql(FEEDS[f])} ORDER BY {"event_id % 3 <> 1 DESC, " if f in IMPORTED_AGAIN else ""}event_id DESC) AS rn
  FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE rn = 1""" for f in VALUE_FEEDS))
def q_feeds_values(spark, sf):
    """What the feeds hold after their loads, row by row: the later batch wins, inside a batch the later event."""
    out = None
    for name, path in _loaded(spark, sf, VALUE_FEEDS).items():
        one = spark.read.parquet(path).select(F.lit(name).alias("feed"), "hostname", "instancename", "dbname", F.col("capture_timestamp").cast("timestamp_ntz").alias("capture_timestamp"), "event_id", "value")
        out = one if out is None else out.unionByName(one)
    return out


NULLABLE_KEYS = FEEDS["connection_info"].keys[3:]


def _wide_sql(part: str) -> str:
    own = ", ".join(f"CASE WHEN user_id % {2 + i} <> 0 THEN '{k}-' || user_id % {5 + i} END AS {k}" for i, k in enumerate(NULLABLE_KEYS))
    return f"""SELECT 'host' || n_regionkey AS hostname, lower(n_name) AS instancename, upper(c_mktsegment) AS dbname, {own}, ts AS capture_timestamp, event_id
  FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE {part}"""


@register("merge_last_seen_wide", f"""
WITH e AS ({_wide_sql("true")})
SELECT {", ".join(FEEDS["connection_info"].keys)}, max(capture_timestamp) AS capture_timestamp,
       coalesce(arg_max(event_id, (capture_timestamp, event_id)) FILTER (WHERE capture_timestamp < TIMESTAMP '{CUT_TARGET}'),
                arg_max(event_id, (capture_timestamp, event_id))) AS event_id
FROM e GROUP BY {", ".join(FEEDS["connection_info"].keys)}""")
def q_merge_last_seen_wide(spark, sf):
    """Connections by eleven keys, eight of them nullable: a connection seen again only has its time moved."""
    feed, path = FEEDS["connection_info"], scratch_path(spark, "connections")
    ev, c, n = table(spark, sf, "events"), table(spark, sf, "customer"), table(spark, sf, "nation")
    own = [F.when(F.col("user_id") % (2 + i) != 0, F.concat(F.lit(f"{k}-"), (F.col("user_id") % (5 + i)).cast("string"))).alias(k) for i, k in enumerate(NULLABLE_KEYS)]
    rows = (ev.join(c, ev.user_id == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select(F.concat(F.lit("host"), F.col("n_regionkey").cast("string")).alias("hostname"), F.lower("n_name").alias("instancename"),
                    F.upper("c_mktsegment").alias("dbname"), *own, F.col("ts").alias(feed.time_col), "event_id"))
    for part in (F.col(feed.time_col) < lit_ts(CUT_TARGET), F.col(feed.time_col) >= lit_ts(CUT_TARGET)):
        # one row per key in a batch, the last by time and event
        batch = dedupe_latest(rows.where(part).withColumn("_at", F.struct(feed.time_col, "event_id")), list(feed.keys), "_at").drop("_at")
        load_batch(spark, feed, path, batch)
    return spark.read.schema(rows.schema).parquet(path).select(*feed.keys, feed.time_col, "event_id")


@register("feeds_load", " UNION ALL ".join(
    f"SELECT '{f}' AS feed, count(*) AS n_rows, count(DISTINCT k) AS n_keys FROM (SELECT DISTINCT ({_feed_key_sql(FEEDS[f])}) AS k "
    "FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey)" for f in LOADED_FEEDS))
def q_feeds_load(spark, sf):
    """All feeds of the registry loaded, several at a time, some as two overlapping batches: every key ends up once."""
    out = None
    for name, path in _loaded(spark, sf, LOADED_FEEDS).items():
        feed, got = FEEDS[name], spark.read.parquet(path)
        one = got.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*feed.keys)).alias("n_keys")).select(F.lit(name).alias("feed"), "n_rows", "n_keys")
        out = one if out is None else out.unionByName(one)
    return out


@register("upsert_reimport", f"""
SELECT ({_feed_key_sql(FEEDS['thr_viol_ev'])}) IS NOT NULL AS keyed, count(DISTINCT ({_feed_key_sql(FEEDS['thr_viol_ev'])})) AS n_rows
FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def q_upsert_reimport(spark, sf):
    """Event rows captured again on a later day replace their older self."""
    feed, path = FEEDS["thr_viol_ev"], scratch_path(spark, "reimport")
    rows = _feed_rows(spark, sf, feed)
    load_batch(spark, feed, path, rows, "event_id")
    load_batch(spark, feed, path, rows.withColumn(feed.time_col, F.col(feed.time_col) + F.expr("INTERVAL 1 DAY")), "event_id")
    return spark.read.parquet(path).groupBy(F.lit(True).alias("keyed")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("feed_slices", """
SELECT feed, count(*) AS n_rows FROM (SELECT unnest(['pkg_cache_stmt', 'dbmcfg', 'reg_variables', 'thr_activi_ev']) AS feed,
  upper(c_mktsegment) AS db FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE n_regionkey = 2) WHERE db = 'MACHINERY' OR feed IN ('dbmcfg', 'reg_variables') GROUP BY feed""")
def q_feed_slices(spark, sf):
    """Keyed slices: database feeds by host and database, instance feeds by host alone."""
    out = None
    for name in ("pkg_cache_stmt", "dbmcfg", "reg_variables", "thr_activi_ev"):
        part = scan_slice(_feed_rows(spark, sf, FEEDS[name]), FEEDS[name], hostname="host2", dbname="machinery")
        one = part.select(F.lit(name).alias("feed"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("feed").agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------------------ retention
PURGE_DAYS_ORDERS = 2000
ARCHIVE_SEGMENTS = ("AUTOMOBILE", "BUILDING")


@register("purge_by_age", f"""
SELECT o_orderkey, o_orderdate FROM orders
WHERE NOT (o_orderdate < {AS_OF_ORDERS_SQL} - INTERVAL {PURGE_DAYS_ORDERS} DAYS)""")
def q_purge_by_age(spark, sf):
    kept, _ = rt.purge_by_age(table(spark, sf, "orders"), "o_orderdate", as_of_orders(), PURGE_DAYS_ORDERS)
    return kept.select("o_orderkey", "o_orderdate")


@register("purge_cascade", f"""
SELECT l.* FROM lineitem l WHERE l.l_orderkey NOT IN (
  SELECT o_orderkey FROM orders WHERE o_orderdate < {AS_OF_ORDERS_SQL} - INTERVAL {PURGE_DAYS_ORDERS} DAYS)""")
def q_purge_cascade(spark, sf):
    """Children of expiring parents go first (anti-join on the parent key), computed once."""
    _, expiring = rt.purge_by_age(table(spark, sf, "orders"), "o_orderdate", as_of_orders(), PURGE_DAYS_ORDERS)
    return rt.purge_cascade(table(spark, sf, "lineitem"), expiring, ["l_orderkey"], ["o_orderkey"])


@register("purge_applied", f"""
SELECT 'orders' AS table_name, count(*) AS n_rows, sum(o_orderkey)::BIGINT AS key_sum FROM orders
WHERE NOT (o_orderdate < {AS_OF_ORDERS_SQL} - INTERVAL {PURGE_DAYS_ORDERS} DAYS)
UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (
  SELECT o_orderkey FROM orders WHERE o_orderdate < {AS_OF_ORDERS_SQL} - INTERVAL {PURGE_DAYS_ORDERS} DAYS)""")
def q_purge_applied(spark, sf):
    """The purge carried out on stored tables: children first, expired folders dropped, the cut month rewritten."""
    month = lambda c: F.date_format(c, "yyyy-MM").alias("part")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", month("o_orderdate"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 8).cast("int").alias("part"))
    op, lp = scratch_path(spark, "purge-orders"), scratch_path(spark, "purge-lineitem")
    clustered(o, ["part"]).write.partitionBy("part").parquet(op)
    clustered(li, ["part"]).write.partitionBy("part").parquet(lp)
    rt.apply_purge(spark, op, "o_orderdate", as_of_orders(), PURGE_DAYS_ORDERS, "part", children=[(lp, "l_orderkey", "o_orderkey", ["part"])])
    sums = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(k).cast("long").alias("key_sum")).select(F.lit(t).alias("table_name"), "n_rows", "key_sum")
            for t, p, k in (("orders", op, "o_orderkey"), ("lineitem", lp, "l_orderkey"))]
    return sums[0].unionByName(sums[1])


@register("purge_conditional", f"""
SELECT e.event_id FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
WHERE NOT (coalesce(c.c_mktsegment IN {ARCHIVE_SEGMENTS}, false) AND e.ts < {AS_OF_EVENTS_SQL} - INTERVAL 10 DAYS)""")
def q_purge_conditional(spark, sf):
    """Age purge applied only to entities in archive-log mode."""
    ev = _events(spark, sf)
    mode = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"),
                                               F.col("c_mktsegment").isin(*ARCHIVE_SEGMENTS).alias("archive"))
    j = ev.join(mode, "user_id", "left")
    expired = F.coalesce(F.col("archive"), F.lit(False)) & (F.col("ts") < as_of_events() - F.expr("INTERVAL 10 DAYS"))
    return j.where(~expired).select("event_id")


@register("purge_whole_days", f"""
SELECT event_id, ts, date_diff('day', ts, {AS_OF_EVENTS_SQL}) - CASE WHEN ts + INTERVAL (date_diff('day', ts, {AS_OF_EVENTS_SQL})) DAY > {AS_OF_EVENTS_SQL} THEN 1 ELSE 0 END AS age_days
FROM events
WHERE (epoch_us({AS_OF_EVENTS_SQL}) - epoch_us(ts)) // 86400000000 > 20""")
def q_purge_whole_days(spark, sf):
    ev = _events(spark, sf)
    return rt.purge_whole_days(ev, "ts", as_of_events(), 20).select(
        "event_id", "ts", whole_days(F.col("ts"), as_of_events()).alias("age_days"))


RET_N = 2
RETAIN_SQL = f"""
WITH b AS (SELECT event_id, user_id AS entity_id, ts,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
                  (epoch_us({AS_OF_EVENTS_SQL}) - epoch_us(ts)) // 86400000000 AS age_days
           FROM events WHERE event_type = 'purchase')
SELECT event_id, entity_id, ts, age_days FROM b WHERE rn > {RET_N} {{extra}}"""


def _retain(spark, sf, mode):
    ev = _events(spark, sf).where(F.col("event_type") == "purchase").select(
        "event_id", F.col("user_id").alias("entity_id"), "ts")
    cand = rt.keep_newest_n(ev, ["entity_id"], "ts", "event_id", RET_N, mode=mode, as_of=as_of_events())
    return cand.select("event_id", "entity_id", "ts", whole_days(F.col("ts"), as_of_events()).alias("age_days"))


@register("retain_newest_n", RETAIN_SQL.format(extra=""))
def q_retain_newest_n(spark, sf):
    return _retain(spark, sf, "count")


@register("retain_n_and_age", RETAIN_SQL.format(extra=f"AND age_days >= {RET_N}"))
def q_retain_n_and_age(spark, sf):
    return _retain(spark, sf, "count_and_age")


@register("empty_groups", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q_empty_groups(spark, sf):
    return rt.empty_groups(table(spark, sf, "orders"), table(spark, sf, "lineitem"),
                           ["o_orderkey"], ["l_orderkey"]).select("o_orderkey")
