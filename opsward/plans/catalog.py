"""Catalog worklists & profiling: parts/suppliers as catalog objects, lineitem/orders as profiled tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ct
from ..operators.latest import latest_with_ties
from ..session import scratch_path
from ..sources.tables import TABLES, table
from .registry import register


@register("table_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, rpad('{t}', 40, ' ') || lpad(CAST(count(*) AS VARCHAR), 20, ' ') AS grid_line FROM {t}"
    for t in TABLES))
def q_table_row_counts(spark, sf):
    return ct.row_counts({t: table(spark, sf, t) for t in TABLES})


PROFILE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_nulls, "
    f"count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM lineitem"
    for c in PROFILE_COLS))
def q_column_profile(spark, sf):
    return ct.column_profile(table(spark, sf, "lineitem"), PROFILE_COLS)


@register("column_profile_approx")
def q_column_profile_approx(spark, sf):
    """Sampled/approximate variant (HyperLogLog++ distinct counts): rows-only check."""
    return ct.column_profile(table(spark, sf, "lineitem"), PROFILE_COLS, approximate=True)


QUANTILE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_suppkey"]


@register("column_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50, quantile_cont({c}::DOUBLE, 0.75) AS q75 FROM lineitem"
    for c in QUANTILE_COLS))
def q_column_quantiles(spark, sf):
    """Distribution of the numeric columns beside their profile."""
    return ct.quantiles(table(spark, sf, "lineitem"), QUANTILE_COLS)


FREQ_COLS = ["l_returnflag", "l_linestatus", "l_quantity", "l_suppkey", "l_shipdate"]
TOP_K = 3


@register("frequent_values", "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value ASC NULLS LAST) AS INTEGER) AS rank FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 2"
                               for c in FREQ_COLS) + f")) WHERE rank <= {TOP_K}")
def q_frequent_values(spark, sf):
    return ct.frequent_values(table(spark, sf, "lineitem"), FREQ_COLS, TOP_K)


@register("compact_preserves_rows", "SELECT * FROM lineitem")
def q_compact_preserves_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    path = ct.compact(li, scratch_path(spark, "compact-lineitem"), ["l_shipdate", "l_orderkey"])
    return spark.read.parquet(path)


# ------------------------------------------------------------------ part catalog
def _parts(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("tabschema"), F.concat(F.lit("PART_"), F.col("p_partkey").cast("string")).alias("tabname"),
        "p_partkey", "p_size", "p_retailprice", "p_type")


PARTS_A_TASK = 50_000


@register("maintenance_worklist", """
WITH t AS (SELECT p_brand AS tabschema, 'PART_' || CAST(p_partkey AS VARCHAR) AS tabname, p_partkey, p_size, p_retailprice FROM part),
     ix AS (SELECT tabschema, tabname, 'IX_' || tabname AS indname FROM t
            UNION ALL SELECT tabschema, tabname, 'IX2_' || tabname FROM t WHERE p_size < 10),
     parts AS (SELECT tabschema, tabname, 'P' || CAST(x AS VARCHAR) AS datapartition FROM t, (VALUES (0), (1)) v(x) WHERE p_size > 25),
     space AS (SELECT tabschema, tabname, CAST(floor(p_retailprice - 950) AS BIGINT) AS reclaimable FROM t WHERE p_retailprice > 950)
SELECT DISTINCT ix.tabschema, ix.tabname, ix.indname, p.datapartition,
  CASE WHEN p.datapartition IS NOT NULL AND s.reclaimable IS NOT NULL
         THEN 'REORG INDEXES ALL FOR TABLE "' || ix.tabschema || '"."' || ix.tabname || '" ALLOW WRITE ACCESS ON DATA PARTITION ' || p.datapartition || ' CLEANUP ALL'
       WHEN p.datapartition IS NOT NULL
         THEN 'REORG INDEXES ALL FOR TABLE "' || ix.tabschema || '"."' || ix.tabname || '" ALLOW WRITE ACCESS ON DATA PARTITION ' || p.datapartition
       WHEN s.reclaimable IS NOT NULL
         THEN 'REORG INDEXES ALL FOR TABLE "' || ix.tabschema || '"."' || ix.tabname || '" ALLOW WRITE ACCESS CLEANUP ALL'
       ELSE 'REORG INDEX "' || ix.tabschema || '"."' || ix.indname || '" FOR TABLE "' || ix.tabschema || '"."' || ix.tabname || '" ALLOW WRITE ACCESS' END AS action
FROM ix LEFT JOIN parts p ON p.tabschema = ix.tabschema AND p.tabname = ix.tabname
        LEFT JOIN space s ON s.tabschema = ix.tabschema AND s.tabname = ix.tabname
        JOIN t ON t.tabschema = ix.tabschema AND t.tabname = ix.tabname""")
def q_maintenance_worklist(spark, sf):
    """Indexes ⟕ data partitions ⟕ space info ⋈ tables -> one REORG action per (index, partition).

    All sides are dealt by their key into as many tasks as the tables ask for, so a task's rows do not grow with the
    catalog. The action follows from the rest of the row: it is worded once the rows are distinct."""
    t = _parts(spark, sf)
    k = ["tabschema", "tabname"]
    tasks = max(spark.sparkContext.defaultParallelism, -(-t.count() // PARTS_A_TASK))
    dealt = lambda df: df.repartition(tasks, *k)
    ix = (t.select(*k, F.concat(F.lit("IX_"), F.col("tabname")).alias("indname"))
          .unionByName(t.where(F.col("p_size") < 10).select(*k, F.concat(F.lit("IX2_"), F.col("tabname")).alias("indname"))))
    parts = t.where(F.col("p_size") > 25).select(*k, F.explode(F.array(F.lit("P0"), F.lit("P1"))).alias("datapartition"))
    space = t.where(F.col("p_retailprice") > 950).select(*k, F.floor(F.col("p_retailprice") - 950).cast("long").alias("reclaimable"))
    j = dealt(ix).join(dealt(parts), k, "left").join(dealt(space), k, "left").join(dealt(t.select(*k)), k, "inner")
    j = j.select(*k, "indname", "datapartition", F.col("reclaimable").isNotNull().alias("recl")).distinct()
    qt = F.concat(F.lit('"'), F.col("tabschema"), F.lit('"."'), F.col("tabname"), F.lit('"'))
    base = F.concat(F.lit("REORG INDEXES ALL FOR TABLE "), qt, F.lit(" ALLOW WRITE ACCESS"))
    part, recl = F.col("datapartition").isNotNull(), F.col("recl")
    action = (F.when(part & recl, F.concat(base, F.lit(" ON DATA PARTITION "), F.col("datapartition"), F.lit(" CLEANUP ALL")))
              .when(part, F.concat(base, F.lit(" ON DATA PARTITION "), F.col("datapartition")))
              .when(recl, F.concat(base, F.lit(" CLEANUP ALL")))
              .otherwise(F.concat(F.lit('REORG INDEX "'), F.col("tabschema"), F.lit('"."'), F.col("indname"),
                                  F.lit('" FOR TABLE '), qt, F.lit(" ALLOW WRITE ACCESS"))))
    return j.select("tabschema", "tabname", "indname", "datapartition", action.alias("action"))


@register("dependents_latest", """
WITH v AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus <> 'P'),
     latest AS (SELECT * FROM v WHERE o_orderdate = (SELECT max(o_orderdate) FROM v v2 WHERE v2.o_custkey = v.o_custkey))
SELECT DISTINCT 'PKG_' || CAST(l.o_custkey AS VARCHAR) AS pkgname, l.o_orderdate AS bind_time, 'PART_' || CAST(li.l_partkey AS VARCHAR) AS tabname
FROM latest l JOIN lineitem li ON li.l_orderkey = l.o_orderkey JOIN part p ON p.p_partkey = li.l_partkey
WHERE p.p_type = 'ECONOMY'""")
def q_dependents_latest(spark, sf):
    """Valid packages (newest bind only, ties kept) that depend on the changed tables."""
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select("o_orderkey", "o_custkey", "o_orderdate")
    latest = latest_with_ties(o, ["o_custkey"], "o_orderdate")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    changed = table(spark, sf, "part").where(F.col("p_type") == "ECONOMY").select(F.col("p_partkey").alias("l_partkey"))
    deps = li.join(changed, "l_partkey", "left_semi")
    j = latest.join(deps, latest.o_orderkey == deps.l_orderkey)
    return j.select(F.concat(F.lit("PKG_"), F.col("o_custkey").cast("string")).alias("pkgname"),
                    F.col("o_orderdate").alias("bind_time"),
                    F.concat(F.lit("PART_"), F.col("l_partkey").cast("string")).alias("tabname")).distinct()


STMT_SQL = """SELECT tabschema, tabname, kind, statement FROM (
  SELECT p_brand AS tabschema, 'PART_' || CAST(p_partkey AS VARCHAR) AS tabname, 'runstats' AS kind,
         'RUNSTATS ON TABLE "' || p_brand || '"."PART_' || CAST(p_partkey AS VARCHAR) || '" WITH DISTRIBUTION AND DETAILED INDEXES ALL' AS statement FROM part
  UNION ALL
  SELECT p_brand, 'PART_' || CAST(p_partkey AS VARCHAR), 'reorg',
         'REORG TABLE "' || p_brand || '"."PART_' || CAST(p_partkey AS VARCHAR) || '" INPLACE ALLOW WRITE ACCESS' FROM part)"""


def _statements(spark, sf):
    t = _parts(spark, sf)
    qt = F.concat(F.lit('"'), F.col("tabschema"), F.lit('"."'), F.col("tabname"), F.lit('"'))
    kinds = F.array(
        F.struct(F.lit("runstats").alias("kind"),
                 F.concat(F.lit("RUNSTATS ON TABLE "), qt, F.lit(" WITH DISTRIBUTION AND DETAILED INDEXES ALL")).alias("statement")),
        F.struct(F.lit("reorg").alias("kind"), F.concat(F.lit("REORG TABLE "), qt, F.lit(" INPLACE ALLOW WRITE ACCESS")).alias("statement")))
    return t.select("tabschema", "tabname", F.explode(kinds).alias("s")).select("tabschema", "tabname", "s.kind", "s.statement")


@register("generate_statements", STMT_SQL)
def q_generate_statements(spark, sf):
    return _statements(spark, sf)


N_CHUNKS = 4


@register("split_worklist", f"""
SELECT tabschema, tabname, rn, CAST(floor((rn - 1) / (floor(cnt / {N_CHUNKS}) + 10)) AS INTEGER) AS chunk FROM (
  SELECT tabschema, tabname, row_number() OVER (ORDER BY tabschema, tabname) AS rn, count(*) OVER () AS cnt
  FROM ({STMT_SQL}) WHERE kind = 'runstats')""")
def q_split_worklist(spark, sf):
    """The statistics worklist split into 4 parallel chunks of floor(n/4)+10 statements."""
    w = _statements(spark, sf).where(F.col("kind") == "runstats").select("tabschema", "tabname")
    return ct.split_in_chunks(spark, w, ["tabschema", "tabname"], N_CHUNKS)


# ------------------------------------------------------------------ supplier catalog
def _supplier_catalog(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.when(F.col("n_nationkey") < 2, F.concat(F.lit("SYS"), F.col("n_name"))).otherwise(F.col("n_name")).alias("tabschema"),
        F.col("s_name").alias("tabname"),
        F.when(F.col("s_acctbal") < 0, "V").otherwise("T").alias("type"))


SUPP_CAT_SQL = """sc AS (
  SELECT CASE WHEN n.n_nationkey < 2 THEN 'SYS' || n.n_name ELSE n.n_name END AS tabschema, s.s_name AS tabname,
         CASE WHEN s.s_acctbal < 0 THEN 'V' ELSE 'T' END AS type
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)"""


@register("catalog_valid_tables", "WITH " + SUPP_CAT_SQL + """
SELECT tabschema, tabname FROM sc WHERE tabschema NOT LIKE 'SYS%' AND type = 'T' AND tabname NOT LIKE '%9'""")
def q_catalog_valid_tables(spark, sf):
    """User schemas only, base tables only, name filter."""
    c = _supplier_catalog(spark, sf)
    return c.where(~F.col("tabschema").like("SYS%") & (F.col("type") == "T") & ~F.col("tabname").like("%9")) \
        .select("tabschema", "tabname")


LIST_CHUNK = 1000


@register("list_per_group", "WITH " + SUPP_CAT_SQL + f"""
SELECT tabschema, chunk, string_agg(tabname, ',' ORDER BY tabname) AS table_list, count(*) AS n_tables FROM (
  SELECT tabschema, tabname, CAST((row_number() OVER (PARTITION BY tabschema ORDER BY tabname) - 1) // {LIST_CHUNK} AS INTEGER) AS chunk
  FROM sc)
GROUP BY tabschema, chunk""")
def q_list_per_group(spark, sf):
    """Comma list of a schema's tables in name order, in chunks of at most 1000 names."""
    c = _supplier_catalog(spark, sf)
    out = ct.ordered_lists(spark, c, ["tabschema"], "tabname", LIST_CHUNK)
    return out.select("tabschema", "chunk", F.col("item_list").alias("table_list"), F.col("n_items").alias("n_tables"))


@register("unpivot_distinct", """
SELECT DISTINCT value FROM (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'PART_' || CAST(l_partkey AS VARCHAR) END AS c1,
         CASE WHEN l_linestatus = 'O' THEN 'SUPP_' || CAST(l_suppkey AS VARCHAR) END AS c2,
         CASE WHEN l_discount >= 0.1 THEN 'ORD_' || CAST(l_orderkey AS VARCHAR) END AS c3 FROM lineitem)
UNPIVOT (value FOR col IN (c1, c2, c3)) WHERE value IS NOT NULL""")
def q_unpivot_distinct(spark, sf):
    """Three nullable columns -> one, NULLs dropped, distinct."""
    li = table(spark, sf, "lineitem")
    wide = li.select(
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("PART_"), F.col("l_partkey").cast("string"))).alias("c1"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("SUPP_"), F.col("l_suppkey").cast("string"))).alias("c2"),
        F.when(F.col("l_discount") >= 0.1, F.concat(F.lit("ORD_"), F.col("l_orderkey").cast("string"))).alias("c3"))
    return wide.unpivot([], ["c1", "c2", "c3"], "col", "value").where(F.col("value").isNotNull()).select("value").distinct()


@register("set_intersect", """
SELECT p_partkey FROM part WHERE p_retailprice > 950
INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'""")
def q_set_intersect(spark, sf):
    """Reclaimable objects restricted to those in use."""
    rec = table(spark, sf, "part").where(F.col("p_retailprice") > 950).select("p_partkey")
    used = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("p_partkey"))
    return rec.intersect(used)
