"""Queries of jobs that keep state: integrity rounds, dated event tables, stored statistics, exports with manifests, rules by substring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import lit_ts
from ..operators import exports as ex
from ..operators import publish as pb
from ..operators import rounds as ir
from ..operators import sketches as sk
from ..operators.dated import upsert_dated
from ..operators.rules import resolve
from ..session import scratch_path
from ..sources.tables import table
from ..streaming.ingest import ingest_dated
from . import freshness as fr
from .bindings import ENTITIES_SQL, with_sql
from .registry import register

N = 25  # tables of each kind
MAX_PRICE, MIN_BALANCE, MAX_QUANTITY = 450_000, -900, 49


def _stored(spark, df, name):
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _integrity_tables(spark, sf):
    """75 tables: customers, orders and lines, each cut by key; every order table refers to its customer table, lines to any order table."""
    c, o, li = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    # a row is known by its id; lines and references are stored once, all rounds read them
    li = _stored(spark, li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity")), "integrity-lines")
    name = lambda kind, col: F.concat(F.lit(kind), (F.col(col) % N).cast("string"))
    line_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = (c.select(name("C", "c_custkey").alias("tab"), F.col("c_custkey").cast("long").alias("id"), (F.col("c_acctbal") >= MIN_BALANCE).alias("ok"))
            .unionByName(o.select(name("O", "o_custkey").alias("tab"), F.col("o_orderkey").cast("long").alias("id"), (F.col("o_totalprice") <= MAX_PRICE).alias("ok")))
            .unionByName(li.select(name("L", "l_orderkey").alias("tab"), line_id.cast("long").alias("id"), (F.col("l_quantity") <= MAX_QUANTITY).alias("ok"))))
    at = o.select("o_orderkey", name("O", "o_custkey").alias("parent"))
    refs = (o.select(name("O", "o_custkey").alias("tab"), F.col("o_orderkey").cast("long").alias("id"), name("C", "o_custkey").alias("parent"), F.col("o_custkey").cast("long").alias("parent_id"))
            .unionByName(li.join(at, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
                name("L", "l_orderkey").alias("tab"), line_id.cast("long").alias("id"), F.coalesce("parent", F.lit("O?")).alias("parent"), F.col("l_orderkey").cast("long").alias("parent_id"))))
    refs = _stored(spark, refs, "integrity-refs")
    ids = spark.range(N).select(F.col("id").cast("string").alias("i"))
    tables = ids.select(F.explode(F.array(*[F.concat(F.lit(k), "i") for k in "COL"])).alias("tab")).withColumn("pending", F.lit(True))
    fks = ids.select(F.concat(F.lit("O"), "i").alias("child"), F.concat(F.lit("C"), "i").alias("parent")).unionByName(
        refs.where(F.col("tab").startswith("L")).select(F.col("tab").alias("child"), "parent").distinct())
    return tables, fks, rows, refs


@register("integrity_rounds", f"""
WITH c AS (SELECT 'C' || c_custkey % {N} AS tab, c_custkey AS id, CASE WHEN c_acctbal < {MIN_BALANCE} THEN 'CHECK' END AS reason FROM customer),
o AS (SELECT 'O' || o_custkey % {N} AS tab, o_orderkey AS id, CASE WHEN o_totalprice > {MAX_PRICE} THEN 'CHECK'
             WHEN o_custkey NOT IN (SELECT id FROM c WHERE reason IS NULL) THEN 'FK' END AS reason FROM orders),
l AS (SELECT 'L' || l_orderkey % {N} AS tab, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_quantity > {MAX_QUANTITY} THEN 'CHECK'
             WHEN l_orderkey NOT IN (SELECT id FROM o WHERE reason IS NULL) THEN 'FK' END AS reason
      FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
e AS (SELECT * FROM c UNION ALL SELECT * FROM o UNION ALL SELECT * FROM l),
t AS (SELECT k || i AS tab FROM (SELECT unnest(range({N})) AS i) x, (VALUES ('C'), ('O'), ('L')) y(k))
SELECT t.tab, false AS pending, count(*) FILTER (WHERE reason = 'CHECK') AS n_check, count(*) FILTER (WHERE reason = 'FK') AS n_fk,
       CAST(coalesce(sum(id) FILTER (WHERE reason IS NOT NULL), 0) AS BIGINT) AS id_sum
FROM t LEFT JOIN e USING (tab) GROUP BY t.tab""")
def q_integrity_rounds(spark, sf):
    """Rounds of at most 50 tables until nothing is pending, in two calls (the second goes on where the first ended): what was diverted from each table, and why."""
    path, args = scratch_path(spark, "rounds"), _integrity_tables(spark, sf)
    ir.resolve_pending(spark, path, *args, most_rounds=1)
    state, gone = ir.resolve_pending(spark, path, *args)
    n = gone.groupBy("tab").agg(F.count(F.when(F.col("reason") == "CHECK", 1)).alias("n_check"), F.count(F.when(F.col("reason") == "FK", 1)).alias("n_fk"), F.sum("id").alias("id_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return state.join(n, "tab", "left").select("tab", "pending", zero("n_check"), zero("n_fk"), zero("id_sum"))


@register("upsert_dated", """
SELECT event_id, user_id, upper(event_type) AS kind, ts + INTERVAL 1 DAY AS ts, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS part FROM events WHERE event_id % 50 = 0
UNION ALL SELECT event_id, user_id, event_type, ts, strftime(ts, '%Y-%m-%d') FROM events WHERE event_id % 50 <> 0""")
def q_upsert_dated(spark, sf):
    """Events by day with a key index: events that come again on a later day leave the day they lay in. All values are compared."""
    path, index = scratch_path(spark, "dated"), scratch_path(spark, "dated-index")
    ev = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), "ts")
    day = lambda df: df.withColumn("part", F.date_format("ts", "yyyy-MM-dd"))
    upsert_dated(spark, path, index, day(ev), ["event_id"], "part", "ts")
    again = ev.where("event_id % 50 = 0").withColumns({"kind": F.upper("kind"), "ts": F.col("ts") + F.expr("INTERVAL 1 DAY")})
    upsert_dated(spark, path, index, day(again), ["event_id"], "part", "ts")
    return spark.read.schema(day(ev).schema).parquet(path).select("event_id", "user_id", "kind", "ts", "part")


@register("stream_ingest_dated", """
WITH again AS (SELECT event_id, user_id, upper(event_type) AS kind, ts + INTERVAL 1 DAY AS ts FROM events WHERE event_id % 70 = 0)
SELECT event_id, user_id, kind, ts, strftime(ts, '%Y-%m-%d') AS part FROM again
UNION ALL SELECT event_id, user_id, event_type, ts, strftime(ts, '%Y-%m-%d') FROM events WHERE event_id % 70 <> 0""")
def q_stream_ingest_dated(spark, sf):
    """Events drained from a drop folder as they come, by day with a key index. Some come again a day later and move there, some
    again with an older time and change nothing. All values are compared."""
    ev = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), "ts")
    day = lambda df: df.withColumn("part", F.date_format("ts", "yyyy-MM-dd"))
    later = ev.where("event_id % 70 = 0").withColumns({"kind": F.upper("kind"), "ts": F.col("ts") + F.expr("INTERVAL 1 DAY")})
    stale = ev.where("event_id % 50 = 0").withColumns({"kind": F.lit("stale"), "ts": F.col("ts") - F.expr("INTERVAL 1 DAY")})
    drop, target = scratch_path(spark, "drop-dated"), scratch_path(spark, "stream-dated")
    day(ev).repartitionByRange(4, "ts").write.parquet(drop)
    day(later.unionByName(stale)).coalesce(1).write.mode("append").parquet(drop)
    ingest_dated(spark, drop, day(ev).schema, target, scratch_path(spark, "stream-dated-index"), scratch_path(spark, "stream-dated-ckpt"),
                 ["event_id"], "part", "ts", max_files_per_trigger=2)
    return spark.read.schema(day(ev).schema).parquet(target).select("event_id", "user_id", "kind", "ts", "part")


PUBLISHED = {"orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "events": "event_id"}


@register("publish_feeds", " UNION ALL ".join(f"SELECT '{t}' AS feed, count(*) AS rows_moved, 0 AS code, CAST(NULL AS VARCHAR) AS reason, count(*) AS n_docs, "
                                              f"CAST(sum({k}) AS BIGINT) AS key_sum FROM {t}" for t, k in PUBLISHED.items())
          + " UNION ALL SELECT 'absent', 0, 1, 'PATH_NOT_FOUND', 0, 0 UNION ALL SELECT 'unknown', 0, 1, 'NO_SUCH_FEED', 0, 0")
def q_publish_feeds(spark, sf):
    """Five feeds, one whose files are gone and a name that is none, published side by side; what the documents hold is read back."""
    base = scratch_path(spark, "publish-feeds")
    feeds = {t: (lambda t=t: spark.read.parquet(f"{sf.rstrip('/')}/{t}.parquet")) for t in (*PUBLISHED, "absent")}
    report = pb.publish_feeds(spark, feeds, base, only=[*feeds, "unknown"])
    back = None
    for t, key in PUBLISHED.items():
        one = spark.read.text(f"{base}/{t}").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.get_json_object("value", f"$.{key}").cast("long")).alias("key_sum"))
        one = one.select(F.lit(t).alias("feed"), "n_docs", "key_sum")
        back = one if back is None else back.unionByName(one)
    return report.join(back, "feed", "left").select("feed", "rows_moved", "code", "reason", F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
                                                    F.coalesce("key_sum", F.lit(0)).alias("key_sum"))


STAT_COLUMNS = ["l_quantity", "l_extendedprice", "l_partkey", "l_returnflag"]
STAT_CUT = "1998-01-01 00:00:00"


@register("statistics_merged", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(DISTINCT strftime(l_shipdate, '%Y-%m')) AS n_parts, count(*) AS n, count(*) - count({c}) AS n_null,
       {f"CAST(min({c}) AS DOUBLE)" if c != "l_returnflag" else "NULL"} AS least, {f"CAST(max({c}) AS DOUBLE)" if c != "l_returnflag" else "NULL"} AS greatest,
       true AS distinct_within FROM lineitem""" for c in STAT_COLUMNS))
def q_statistics_merged(spark, sf):
    """Statistics kept per month and merged: the months that were there first are not read again. The distinct counts must lie within 5 % of the exact ones."""
    path, stats = scratch_path(spark, "stat-table"), scratch_path(spark, "stats")
    li = table(spark, sf, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM")).select(*STAT_COLUMNS, "l_shipdate", "month")
    for part in (li.where(F.col("l_shipdate") < lit_ts(STAT_CUT)), li.where(F.col("l_shipdate") >= lit_ts(STAT_CUT))):
        part.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)
        sk.update_statistics(spark, spark.read.schema(li.schema).parquet(path), "month", STAT_COLUMNS, stats)
    exact = li.agg(*[F.count_distinct(c).alias(c) for c in STAT_COLUMNS])
    exact = exact.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in STAT_COLUMNS])).alias("e")).select("e.*")
    p = sk.profile(spark.read.schema(sk.STATS).parquet(stats)).join(exact, "column")
    return p.select(F.col("column").alias("column_name"), "n_parts", "n", "n_null", "least", "greatest",
                    (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.05 * F.col("exact")).alias("distinct_within"))


@register("export_manifest", """
SELECT o_orderstatus AS status, strftime(o_orderdate, '%Y') AS year, count(*) AS n_rows FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2
UNION ALL SELECT 'P', strftime(o_orderdate, '%Y'), count(*) FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000 GROUP BY 2""")
def q_export_manifest(spark, sf):
    """The manifest after an export and a second one that replaces one status, counted from the footers."""
    path = scratch_path(spark, "export-manifest")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy").alias("year"))
    ex.export_with_manifest(o.where("status <> 'P'"), path, ["status", "year"])
    got = ex.export_with_manifest(o.where("status = 'P' and o_totalprice > 100000"), path, ["status", "year"])
    return got.select("status", F.col("year").cast("string").alias("year"), "n_rows")


CONTAINS_SQL = """entity_kinds AS (SELECT e.*, kd.kind FROM entities e, (VALUES ('regular'), ('snapshot')) kd(kind)),
cand AS (
  SELECT k.entity_id, k.kind, r.line_no, r.warn_h, r.crit_h, (r.host <> '*')::INT + (r.instance <> '*')::INT + (r.dbname <> '*')::INT AS spec
  FROM entity_kinds k JOIN (SELECT * FROM parsed_rules WHERE excluded IS NULL) r ON r.kind = k.kind
   AND (r.host = '*' AND r.instance = '*' AND r.dbname = '*' OR r.host <> '*' AND contains(r.host, lower(k.host))
        AND (r.instance = '*' AND r.dbname = '*' OR r.instance <> '*' AND contains(r.instance, lower(k.instance))
             AND (r.dbname = '*' OR contains(r.dbname, lower(k.dbname)))))),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, kind ORDER BY spec DESC, line_no DESC) AS rn FROM cand) WHERE rn = 1)"""


@register("rule_contains", with_sql(ENTITIES_SQL, fr.THRESHOLD_LINES_SQL, fr.PARSED_RULES_SQL, CONTAINS_SQL) + f"""
SELECT k.entity_id, k.kind, b.line_no, CASE WHEN b.line_no IS NULL THEN {fr.DEFAULT_WARN} ELSE b.warn_h END AS warn_h,
       CASE WHEN b.line_no IS NULL THEN {fr.DEFAULT_CRIT} ELSE b.crit_h END AS crit_h
FROM entity_kinds k LEFT JOIN best b USING (entity_id, kind)""")
def q_rule_contains(spark, sf):
    """Thresholds with rules that stand for every name in their parts: ``nation1`` also meets the lines of ``nation10`` to ``nation19``."""
    thr = fr.parsed_rules(spark, sf).where(F.col("excluded").isNull() & F.col("kind").isin(*fr.KINDS))
    return resolve(fr.entity_kinds(spark, sf), thr, ["entity_id"], ["warn_h", "crit_h"], match_cols=["kind"],
                   defaults={"warn_h": fr.DEFAULT_WARN, "crit_h": fr.DEFAULT_CRIT}, match="contains").select("entity_id", "kind", "line_no", "warn_h", "crit_h")
