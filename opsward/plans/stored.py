"""Queries that read files: scripts by byte range, drop files through the load ledger, purges with odd partition values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as cp
from ..operators import exports as ex
from ..operators import ledger as lg
from ..operators import phases as ph
from ..operators import retention as rt
from ..operators.lineage import durable
from ..operators.upsert import write_partitions
from ..session import scratch_path
from ..sources.files import clustered, scan_slices
from ..sources.listing import list_files, write_named
from ..sources.tables import table
from ..sources.text import script_lines, write_scripts
from .bindings import AS_OF_ORDERS_SQL, as_of_orders, with_sql
from .corpus import BLOCKS_SQL, CHUNK_LINES, LINES_SQL, _script_lines
from .registry import register

DENSE_SQL = LINES_SQL.replace("lines AS (", "raw_lines AS (", 1) + """,
lines AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no) AS line_no, line FROM raw_lines)"""


@register("extract_blocks_files", with_sql(DENSE_SQL, BLOCKS_SQL) + "SELECT substr(file, 5) AS script, begin_line, kind, schema, name, n_lines FROM objects")
def q_extract_blocks_files(spark, sf):
    """The schema scripts as stored text files, read by byte range; object blocks with line numbers in the file."""
    lines = _script_lines(spark, sf).withColumn("file", F.substring("file", 5, 1000))
    path = write_scripts(lines, scratch_path(spark, "scripts"))
    b = cp.extract_blocks(script_lines(spark, path), CHUNK_LINES)
    folder = F.regexp_extract("file", r"/script=([^/]+)/", 1)
    return b.select(F.url_decode(F.url_decode(folder)).alias("script"), "begin_line", "kind", "schema", "name", "n_lines")


PAGE_FILES = 4


@register("script_lines_pages", f"""
WITH l AS (SELECT page_id % {PAGE_FILES} AS script, page_id, unnest(string_split(html, chr(10))) AS line, unnest(range(len(string_split(html, chr(10))))) AS i FROM pages
           WHERE html IS NOT NULL),
n AS (SELECT script, rtrim(line, chr(13)) AS line, row_number() OVER (PARTITION BY script ORDER BY page_id, i) AS line_no FROM l)
SELECT CAST(script AS VARCHAR) AS script, count(*) AS n_lines, max(line_no) AS last_line, CAST(sum(length(line)) AS BIGINT) AS n_chars,
       CAST(sum(line_no * length(line)) AS BIGINT) AS weighted, min(line_no) FILTER (WHERE contains(line, '<title>')) AS first_title
FROM n GROUP BY script""")
def q_script_lines_pages(spark, sf):
    """All pages in a few large text files, read back by byte range with exact line numbers."""
    p = table(spark, sf, "pages").where("html is not null")
    path = write_scripts(p.select((F.col("page_id") % PAGE_FILES).cast("string").alias("file"), "page_id", "html"), scratch_path(spark, "pages-text"),
                         order_col="page_id", text_col="html")
    lines = script_lines(spark, path)
    size = F.length("line")
    return lines.groupBy(F.regexp_extract("file", r"/script=([^/]+)/", 1).alias("script")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line"), F.sum(size).cast("long").alias("n_chars"),
        F.sum(F.col("line_no") * size).cast("long").alias("weighted"), F.min(F.when(F.col("line").contains("<title>"), F.col("line_no"))).alias("first_title"))


@register("object_files", with_sql(LINES_SQL, BLOCKS_SQL) + """
, m AS (SELECT o.kind, o.schema, o.name, mm.line FROM objects o JOIN members mm ON mm.file = o.file AND mm.rb = o.begin_line)
SELECT kind || '/' || schema || '/' || name AS object, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM m GROUP BY 1""")
def q_object_files(spark, sf):
    """Object files named by key, read back: what each file holds."""
    base = scratch_path(spark, "objects")
    cp.write_object_files(_script_lines(spark, sf), base, CHUNK_LINES)
    lines = script_lines(spark, base, "*.ddl")
    name = F.url_decode(F.regexp_extract("file", r"/objects-[0-9a-f]+/(.+)\.ddl$", 1))
    return lines.groupBy(name.alias("object")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@register("manifest_sorted", """
SELECT row_number() OVER (ORDER BY source, lang, doc_id) AS line_no, source || ':' || lang || ':' || doc_id AS line FROM documents
WHERE source IS NOT NULL AND lang IS NOT NULL""")
def q_manifest_sorted(spark, sf):
    """The manifest of all documents in one order over its part files, read back with numbers."""
    d = table(spark, sf, "documents").where("source is not null and lang is not null")
    path = cp.write_sorted(d, scratch_path(spark, "manifest"), ["source", "lang", "doc_id"], F.concat_ws(":", "source", "lang", "doc_id"))
    return cp.read_sorted(script_lines(spark, path, "part-*"))


@register("scan_many_slices", """
SELECT o_orderkey, o_totalprice, o_orderstatus AS host, strftime(o_orderdate, '%Y-%m') AS day FROM orders
WHERE (o_orderstatus, strftime(o_orderdate, '%Y-%m')) IN (SELECT l_linestatus, strftime(l_shipdate, '%Y-%m') FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1)""")
def q_scan_many_slices(spark, sf):
    """A list of slices (from the line items) against a table laid out by host and month: one scan of the listed folders."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("host"), F.date_format("o_orderdate", "yyyy-MM").alias("day"))
    path, listed = scratch_path(spark, "by-slice"), scratch_path(spark, "slices")
    clustered(o, ["host", "day"]).write.partitionBy("host", "day").parquet(path)
    li = table(spark, sf, "lineitem").where("l_quantity = 50 and l_linenumber = 1")
    li.select(F.col("l_linestatus").alias("host"), F.date_format("l_shipdate", "yyyy-MM").alias("day")).distinct().write.parquet(listed)
    return scan_slices(spark, path, spark.read.parquet(listed), ["host", "day"]).select("o_orderkey", "o_totalprice", "host", "day")


LOCKED = "n_nationkey % 7 = 3"


@register("maintenance_phases", f"""
WITH t AS (SELECT r_name AS schema, n_name AS tab, {LOCKED} AS locked, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n
           FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT * FROM (VALUES (0, 'runstats'), (1, 'reorg'), (2, 'reorgidx'), (3, 'runstats')) v(step, phase)),
s AS (SELECT * FROM (VALUES (4, 'rebind'), (5, 'reduce')) v(step, phase))
SELECT schema, tab, step, phase, CASE WHEN locked AND step = 1 THEN 2 ELSE 1 END AS attempts, CAST(CASE WHEN phase = 'reorgidx' THEN 0 ELSE n END AS BIGINT) AS n FROM t, p
UNION ALL SELECT schema, NULL, step, phase, 1, CAST(count(*) AS BIGINT) FROM t, s GROUP BY schema, step, phase""")
def q_maintenance_phases(spark, sf):
    """The phase plan over a table per nation; some are locked in the first run. The second run takes those up and leaves what is done."""
    n, r, c = (table(spark, sf, t) for t in ("nation", "region", "customer"))
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("schema"), F.col("n_name").alias("tab"), "n_nationkey", F.expr(LOCKED).alias("locked"))
    base, journal = scratch_path(spark, "phase-table"), scratch_path(spark, "journal")
    c.select("c_custkey", "c_acctbal", "c_nationkey").write.partitionBy("c_nationkey").parquet(base)
    schema = c.select("c_custkey", "c_acctbal", "c_nationkey").schema

    def named(todo):
        return todo.join(nations.withColumnRenamed("schema", "_s"), (F.col("schema") == F.col("_s")) & todo["tab"].eqNullSafe(nations["tab"])).select("schema", todo["tab"], "n_nationkey", "locked")

    def counted(todo, ok):
        rows = spark.read.schema(schema).parquet(base).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"))
        return named(todo).join(rows, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("schema", "tab", ok.alias("ok"), F.coalesce("c", F.lit(0)).alias("n"))

    def reorg(first):
        def run(todo):
            keys = named(todo).where("true" if not first else "not locked").select(F.col("n_nationkey").alias("c_nationkey"))
            rows = durable(spark.read.schema(schema).parquet(base).join(keys, "c_nationkey", "left_semi").select(*schema.names))
            write_partitions(rows.sortWithinPartitions("c_nationkey", "c_custkey"), base, ["c_nationkey"])
            return counted(todo, ~F.col("locked") if first else F.lit(True))  # listed anew, after the write
        return run

    stats = lambda todo: counted(todo, F.lit(True))
    index = lambda todo: todo.select("schema", "tab", F.lit(True).alias("ok"), F.lit(0).alias("n"))
    whole = lambda todo: todo.join(nations.groupBy(F.col("schema").alias("_s")).agg(F.count(F.lit(1)).alias("n")), F.col("schema") == F.col("_s")).select(
        "schema", "tab", F.lit(True).alias("ok"), "n")
    work = ph.plan(nations.select("schema", "tab"), ["runstats", "reorg", "reorgidx", "runstats"], ["rebind", "reduce"])
    for first in (True, False):
        ph.run_plan(spark, journal, work, {"runstats": stats, "reorg": reorg(first), "reorgidx": index, "rebind": whole, "reduce": whole})
    j = spark.read.schema(ph.JOURNAL).parquet(journal)
    return j.groupBy("schema", "tab", "step", "phase").agg(F.count(F.lit(1)).cast("int").alias("attempts"), F.max_by("n", "at").alias("n"))


@register("purge_files", """
SELECT p_size % 40 AS file_no, count(*) AS n_rows FROM part WHERE p_size % 40 < 30 GROUP BY 1""")
def q_purge_files(spark, sf):
    """Files named by key and aged by their number; those of 30 days and more are deleted: rows of the files that are left."""
    base = scratch_path(spark, "aged")
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 40).alias("file_no"))
    write_named(p, base, F.concat(F.lit("f"), F.lpad(F.col("file_no").cast("string"), 2, "0")))
    jvm, now = spark.sparkContext._jvm, 1_700_000_000
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in list_files(spark, base, "f*.parquet").collect():  # at most 40 files
        fs.setTimes(path(r.path), (now - 86_400 * int(r.name[1:3])) * 1000, -1)
    ex.purge_files(spark, base, F.timestamp_seconds(F.lit(now)), 30, "f*.parquet", dry_run=False)
    return spark.read.parquet(base).groupBy("file_no").agg(F.count(F.lit(1)).alias("n_rows"))


DROP_SCHEMA = "k long, v double"
INSTANCE_FEEDS = ["SYSIBMADM.DBMCFG"]


def _drop_files(spark, sf) -> str:
    """Files of a database feed (from orders, four-part names) and of an instance feed (from suppliers, three-part names), and two bad ones."""
    o, s = table(spark, sf, "orders"), table(spark, sf, "supplier")
    base = scratch_path(spark, "drop")
    name = F.concat(F.lit("ora_"), F.lower("o_orderstatus"), F.lit("_inst"), F.substring("o_orderpriority", 1, 1), F.lit("_TPCH_ABSDBA.ORDERS"))
    key = F.when(F.col("o_totalprice") <= 400000, F.col("o_orderkey"))
    write_named(o.select(key.alias("k"), F.col("o_totalprice").alias("v"), name.alias("n")), base, F.col("n"))
    name = F.concat(F.lit("host"), F.col("s_nationkey").cast("string"), F.lit("_db2inst1_SYSIBMADM.DBMCFG"))
    write_named(s.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), name.alias("n")), base, F.col("n"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(conf)
    some = list_files(spark, base, "ora_o_inst1_*").first()
    # a copy that stops half way, and a whole file whose name says nothing
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path(some.path), fs, path(path(base), "notes.parquet"), False, conf)
    inp, out = fs.open(path(some.path)), fs.create(path(path(base), "ora_x_inst1_TPCH_ABSDBA.ORDERS.parquet"), True)
    out.write(bytearray(inp.readNBytes(min(some.bytes // 2, 1 << 20))))
    inp.close()
    out.close()
    return base


@register("load_ledger", """
WITH o AS (SELECT 'ora_' || lower(o_orderstatus) AS host, 'inst' || substr(o_orderpriority, 1, 1) AS instance, o_totalprice FROM orders),
f AS (
  SELECT host, instance, 'TPCH' AS dbname, 'ABSDBA.ORDERS' AS feed, 'done' AS state, count(*) FILTER (WHERE o_totalprice <= 400000) AS n_rows,
         count(*) FILTER (WHERE o_totalprice > 400000) AS n_rejects, 1 AS attempts FROM o GROUP BY host, instance
  UNION ALL SELECT 'host' || s_nationkey, 'db2inst1', NULL, 'SYSIBMADM.DBMCFG', 'done', count(*), 0, 1 FROM supplier GROUP BY s_nationkey
  UNION ALL SELECT 'ora_x', 'inst1', 'TPCH', 'ABSDBA.ORDERS', 'failed', 0, 0, 2
  UNION ALL SELECT NULL, NULL, NULL, NULL, 'failed', 0, 0, 2)
SELECT host, instance, dbname, feed, state, n_rows, n_rejects, attempts FROM f""")
def q_load_ledger(spark, sf):
    """Two runs of the loader over the same drop folder: the second takes only the two bad files again."""
    base = _drop_files(spark, sf)
    at, target, rejects = (scratch_path(spark, x) for x in ("ledger", "landing", "rejects"))
    for _ in range(2):
        lg.load_pending(spark, base, at, target, rejects, DROP_SCHEMA, ["k"], INSTANCE_FEEDS)
    ledger = lg.read_ledger(spark, at)
    tries = ledger.where(F.col("state").isin(*lg.ENDED)).groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("attempts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (lg.latest_state(ledger).join(tries, "path")
            .select("host", "instance", "dbname", "feed", "state", zero("n_rows"), zero("n_rejects"), "attempts"))


@register("load_ledger_rows", """
SELECT 'ora_' || lower(o_orderstatus) AS host, 'TPCH' AS dbname, o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_totalprice <= 400000
UNION ALL SELECT 'host' || s_nationkey, NULL, s_suppkey, s_acctbal FROM supplier""")
def q_load_ledger_rows(spark, sf):
    """What the ledger's loads have landed, with the keys of the files' names."""
    base = _drop_files(spark, sf)
    at, target, rejects = (scratch_path(spark, x) for x in ("ledger", "landing", "rejects"))
    for feed in (["ABSDBA.ORDERS"], None):  # one feed by choice, then what is left
        lg.load_pending(spark, base, at, target, rejects, DROP_SCHEMA, ["k"], INSTANCE_FEEDS, feed)
    return spark.read.parquet(target).select("host", "dbname", "k", "v")


PURGE_DAYS = 1200


@register("purge_cascaded", f"""
WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderdate < {AS_OF_ORDERS_SQL} - INTERVAL {PURGE_DAYS} DAYS),
l AS (SELECT *, l_orderkey IN (SELECT o_orderkey FROM gone) AS g FROM lineitem)
SELECT 'orders' AS table_name, (SELECT count(*) FROM gone) AS purged, count(*) - (SELECT count(*) FROM gone) AS n_left FROM orders
UNION ALL SELECT 'lineitem', count(*) FILTER (WHERE g), count(*) FILTER (WHERE NOT g) FROM l
UNION ALL SELECT 'shipment', count(*) FILTER (WHERE g), count(*) FILTER (WHERE NOT g) FROM l WHERE l_quantity > 25""")
def q_purge_cascaded(spark, sf):
    """Two levels of children, in partitions whose values are NULL or need escaping: what the purge reports is gone."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("part"))
    li = table(spark, sf, "lineitem")
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_key")
    odd = F.when(F.col("l_linestatus") == "F", F.concat_ws(":", "l_returnflag", F.date_format("l_shipdate", "yyyy/MM"))).alias("part")
    child = li.select("l_orderkey", line, odd)
    grand = li.where("l_quantity > 25").select(line.alias("of_line"), "l_quantity", F.when(F.col("l_returnflag") != "N", F.concat("l_shipmode" if "l_shipmode" in li.columns else "l_returnflag", F.lit("=a b%"))).alias("part"))
    paths = {}
    for name, df in (("orders", o), ("lineitem", child), ("shipment", grand)):
        paths[name] = scratch_path(spark, f"purge-{name}")
        clustered(df, ["part"]).write.partitionBy("part").parquet(paths[name])
    counts = rt.apply_purge(spark, paths["orders"], "o_orderdate", as_of_orders(), PURGE_DAYS, "part", children=[
        (paths["lineitem"], "l_orderkey", "o_orderkey", ["part"], [(paths["shipment"], "of_line", "line_key", ["part"])])])
    return spark.createDataFrame([(n, counts[p], spark.read.parquet(p).count()) for n, p in paths.items()], "table_name string, purged long, n_left long")
