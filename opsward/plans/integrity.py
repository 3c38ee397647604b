"""Integrity family: lineitem -> orders -> customer with filtered parents; catalog = parts/suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as msg
from ..operators import integrity as ig
from ..session import scratch_path
from ..sources.files import read_typed_csv
from ..sources.tables import table
from .bindings import AS_OF_ORDERS_SQL, HISTORY_SQL, as_of_orders, history, with_sql
from .registry import register

LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
# the parent table only holds open/pending orders -> lines of finished orders break the FK
PARENT_FILTER = "o_orderstatus <> 'F'"


def _parents(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderstatus") != "F")


def _check(c=F.col):
    return (c("l_quantity") <= 48) & (c("l_discount") <= 0.09)


CHECK_SQL = "(l_quantity <= 48 AND l_discount <= 0.09)"


@register("validate_fk", f"""
SELECT l.* FROM lineitem l WHERE l.l_orderkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND {PARENT_FILTER})""")
def q_validate_fk(spark, sf):
    return ig.fk_violations(table(spark, sf, "lineitem"), _parents(spark, sf), ["l_orderkey"], ["o_orderkey"])


@register("validate_unique", """
SELECT l.*, d.dup_count FROM lineitem l JOIN (
  SELECT l_orderkey, l_linenumber, count(*) AS dup_count FROM lineitem GROUP BY ALL HAVING count(*) > 1) d
  USING (l_orderkey, l_linenumber)""")
def q_validate_unique(spark, sf):
    return ig.unique_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select(*LINE_COLS, "dup_count")


@register("validate_check", f"SELECT * FROM lineitem WHERE NOT coalesce({CHECK_SQL}, true)")
def q_validate_check(spark, sf):
    return ig.check_violations(table(spark, sf, "lineitem"), _check())


@register("divert_exceptions", f"""
WITH t AS (
  SELECT l.*,
    list_filter([CASE WHEN l.l_orderkey IS NOT NULL AND p.o_orderkey IS NULL THEN 'fk_orders' END,
                 CASE WHEN d.n IS NOT NULL THEN 'unique_line' END,
                 CASE WHEN NOT coalesce({CHECK_SQL}, true) THEN 'check_qty_disc' END], lambda x: x IS NOT NULL) AS r
  FROM lineitem l
  LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE {PARENT_FILTER}) p ON l.l_orderkey = p.o_orderkey
  LEFT JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) d
    ON l.l_orderkey = d.l_orderkey AND l.l_linenumber = d.l_linenumber)
SELECT * EXCLUDE (r), {AS_OF_ORDERS_SQL} AS n1_timestamp, array_to_string(list_sort(r), ',') AS n2_info
FROM t WHERE len(r) > 0""")
def q_divert_exceptions(spark, sf):
    """Single tagging pass; the exception set is the source shape + timestamp + reasons."""
    li = table(spark, sf, "lineitem")
    tagged = ig.tag_violations(
        li,
        fk=[("fk_orders", _parents(spark, sf), ["l_orderkey"], ["o_orderkey"])],
        unique=[("unique_line", ["l_orderkey", "l_linenumber"])],
        checks=[("check_qty_disc", _check())])
    _, exc = ig.divert(tagged, as_of_orders())
    return exc


@register("export_exceptions", """
SELECT l_orderkey, l_linenumber, l_quantity, 'check_qty' AS n2_info FROM lineitem WHERE NOT coalesce(l_quantity <= 45, true)""")
def q_export_exceptions(spark, sf):
    """Exception rows as delimited files on shared storage, read back with declared types."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    _, exc = ig.divert(ig.tag_violations(li, checks=[("check_qty", F.col("l_quantity") <= 45)]), as_of_orders())
    path = ig.export_exceptions(exc, scratch_path(spark, "exceptions"))
    back = read_typed_csv(spark, path, "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, n1_timestamp TIMESTAMP_NTZ, n2_info STRING", corrupt_col=None)
    return back.select("l_orderkey", "l_linenumber", "l_quantity", "n2_info")


@register("divert_cascade", """
WITH bad_c AS (SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal >= 0, true)),
     bad_o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM bad_c)),
     bad_l AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM bad_o))
SELECT 'customer' AS table_name, c_custkey AS key1, CAST(NULL AS INTEGER) AS key2, 'check' AS reason FROM bad_c
UNION ALL SELECT 'orders', o_orderkey, NULL, 'parent:customer' FROM bad_o
UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber, 'parent:orders' FROM bad_l""")
def q_divert_cascade(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("customer", "orders", "lineitem")}
    edges = [("orders", ["o_custkey"], "customer", ["c_custkey"]),
             ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"])]
    d = ig.divert_cascade(tables, ["customer", "orders", "lineitem"], edges,
                          {"customer": F.col("c_acctbal") >= 0})
    c = d["customer"].select(F.lit("customer").alias("table_name"), F.col("c_custkey").alias("key1"),
                             F.lit(None).cast("int").alias("key2"), "reason")
    o = d["orders"].select(F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("key1"),
                           F.lit(None).cast("int").alias("key2"), "reason")
    li = d["lineitem"].select(F.lit("lineitem").alias("table_name"), F.col("l_orderkey").alias("key1"),
                              F.col("l_linenumber").alias("key2"), "reason")
    return c.unionByName(o).unionByName(li)


@register("divert_cascade_self", """
WITH RECURSIVE e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 3 ELSE c_custkey // 2 END AS boss, c_acctbal FROM customer),
w AS (SELECT id FROM e WHERE c_acctbal < -900 UNION SELECT e.id FROM e JOIN w ON e.boss = w.id)
SELECT id, concat_ws(',', CASE WHEN c_acctbal < -900 THEN 'check' END, CASE WHEN boss IN (SELECT id FROM w) THEN 'parent:staff' END) AS reason
FROM e WHERE id IN (SELECT id FROM w)""")
def q_divert_cascade_self(spark, sf):
    """A table that references itself (long chains, some cycles): exceptions reach every descendant."""
    key = F.col("c_custkey").cast("long")
    staff = table(spark, sf, "customer").select(
        key.alias("id"), F.when(key % 7 == 0, key + 3).otherwise(F.floor(key / 2)).alias("boss"), "c_acctbal")
    d = ig.divert_cascade({"staff": staff}, ["staff"], [("staff", ["boss"], "staff", ["id"])], {"staff": F.col("c_acctbal") >= -900})
    return d["staff"].select("id", "reason")


# ----------------------------------------------------------------- catalog of parts & suppliers
def _catalog(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_brand").alias("tabschema"), F.concat(F.lit("PART_"), F.col("p_partkey").cast("string")).alias("tabname"),
        (F.col("p_size") < 3).alias("pending"))
    s = table(spark, sf, "supplier").select(
        F.lit("SUPP").alias("tabschema"), F.concat(F.lit("SUPP_"), F.col("s_suppkey").cast("string")).alias("tabname"),
        (F.col("s_acctbal") < 0).alias("pending"))
    return p.unionByName(s)


def _references(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("p_brand").alias("tabschema"), F.concat(F.lit("PART_"), F.col("l_partkey").cast("string")).alias("tabname"),
        F.lit("SUPP").alias("reftabschema"), F.concat(F.lit("SUPP_"), F.col("l_suppkey").cast("string")).alias("reftabname"))


CATALOG_SQL = """catalog AS (
  SELECT p_brand AS tabschema, 'PART_' || CAST(p_partkey AS VARCHAR) AS tabname, p_size < 3 AS pending FROM part
  UNION ALL SELECT 'SUPP', 'SUPP_' || CAST(s_suppkey AS VARCHAR), s_acctbal < 0 FROM supplier),
refs AS (
  SELECT DISTINCT p.p_brand AS tabschema, 'PART_' || CAST(l.l_partkey AS VARCHAR) AS tabname,
         'SUPP' AS reftabschema, 'SUPP_' || CAST(l.l_suppkey AS VARCHAR) AS reftabname
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l JOIN part p ON l.l_partkey = p.p_partkey)"""


@register("pending_tables", with_sql(CATALOG_SQL) + """
SELECT tabschema, tabname FROM (
  SELECT tabschema, tabname FROM catalog WHERE pending
  UNION
  SELECT c.tabschema, c.tabname FROM catalog c
  WHERE c.pending AND EXISTS (SELECT 1 FROM refs r JOIN catalog k ON k.tabschema = r.tabschema AND k.tabname = r.tabname
                              WHERE k.pending AND r.reftabschema = c.tabschema AND r.reftabname = c.tabname))""")
def q_pending_tables(spark, sf):
    """Flagged tables ∪ flagged parents of flagged children, all of them."""
    return ig.pending_set(_catalog(spark, sf), _references(spark, sf))


@register("fk_closure", with_sql(CATALOG_SQL) + """,
edges AS (
  SELECT tabschema || '.' || tabname AS child, reftabschema || '.' || reftabname AS parent FROM refs
  UNION SELECT 'SUPP.SUPP_' || CAST(s_suppkey AS VARCHAR), 'NATION.N_' || CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION SELECT 'NATION.N_' || CAST(n_nationkey AS VARCHAR), 'REGION.R_' || CAST(n_regionkey AS VARCHAR) FROM nation),
start AS (SELECT tabschema || '.' || tabname AS name FROM catalog WHERE pending AND tabschema <> 'SUPP'),
walk AS (
  WITH RECURSIVE w(name, depth) AS (
    SELECT name, 0 FROM start
    UNION SELECT e.parent, w.depth + 1 FROM w JOIN edges e ON e.child = w.name)
  SELECT * FROM w)
SELECT name, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY name""")
def q_fk_closure(spark, sf):
    """Parents reachable from the pending parts: part -> supplier -> nation -> region."""
    refs = _references(spark, sf).select(
        F.concat_ws(".", "tabschema", "tabname").alias("child"), F.concat_ws(".", "reftabschema", "reftabname").alias("parent"))
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("SUPP.SUPP_"), F.col("s_suppkey").cast("string")).alias("child"),
        F.concat(F.lit("NATION.N_"), F.col("s_nationkey").cast("string")).alias("parent"))
    n = table(spark, sf, "nation").select(
        F.concat(F.lit("NATION.N_"), F.col("n_nationkey").cast("string")).alias("child"),
        F.concat(F.lit("REGION.R_"), F.col("n_regionkey").cast("string")).alias("parent"))
    edges = refs.unionByName(s).unionByName(n)
    start = _catalog(spark, sf).where(F.col("pending") & (F.col("tabschema") != "SUPP")).select(
        F.concat_ws(".", "tabschema", "tabname").alias("name"))
    return ig.closure(spark, start, edges)


TRUNC_WIDTH = 8


@register("resolve_prefix", f"""
WITH cat AS (SELECT p_brand AS tabschema, 'PART_' || CAST(p_partkey AS VARCHAR) AS tabname, p_size FROM part),
     t AS (SELECT DISTINCT tabschema, substr(tabname, 1, {TRUNC_WIDTH}) AS truncated FROM cat WHERE p_size < 3)
SELECT t.tabschema, t.truncated, count(c.tabname) AS n_matches,
       CASE WHEN count(c.tabname) = 0 THEN 'none' WHEN count(c.tabname) = 1 THEN 'unique' ELSE 'ambiguous' END AS resolution,
       CASE WHEN count(c.tabname) = 1 THEN min(c.tabname) END AS resolved
FROM t LEFT JOIN cat c ON c.tabschema = t.tabschema AND starts_with(c.tabname, t.truncated)
GROUP BY t.tabschema, t.truncated""")
def q_resolve_prefix(spark, sf):
    """Names chopped to 8 characters in error messages, completed within their schema."""
    cat = table(spark, sf, "part").select(
        F.col("p_brand").alias("tabschema"), F.concat(F.lit("PART_"), F.col("p_partkey").cast("string")).alias("tabname"),
        "p_size")
    trunc = cat.where(F.col("p_size") < 3).select("tabschema", F.substring("tabname", 1, TRUNC_WIDTH).alias("truncated"))
    return ig.resolve_prefix(trunc, cat, "tabschema", "tabname", "truncated")


# ----------------------------------------------------------------- message classification
# Codes rendered into utility output, indexed by floor(k / 7) of the event.
RENDER_CODES = ["SQL3600N", "SQL3608N", "SQL0104N", "SQL3603N", "SQL0101N", "SQL0668N", "SQL0290N", "SQL0204N",
                "SQL0171N", "SQL1224N", "SQL1024N", "SQL0100W", "SQL3110N", "SQL3205N", "SQL9999C"]


def _messages(spark, sf):
    h = history(spark, sf).where(F.col("operation") == "L")
    code = F.element_at(F.array(*[F.lit(c) for c in RENDER_CODES]), F.floor(F.col("k") / 7).cast("int") + 1)
    lines = F.array(
        F.when(F.col("k") < 30, F.concat(F.lit('SQL3109N  The utility is beginning to load data from file "f'),
                                         F.col("event_id").cast("string"), F.lit('.del".'))),
        F.concat(code, F.lit("  Message for event "), F.col("event_id").cast("string"), F.lit(" on "),
                 F.col("tabschema"), F.lit("."), F.col("tabname")),
        F.when(F.col("value") >= 250, F.lit("SQL3110N  The utility has completed processing.")))
    text = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    rc = F.when(F.col("value") < 400, F.lit(0)).otherwise(F.lit(4))
    return h.select("event_id", code.alias("rendered_code"), text.alias("text"), rc.alias("rc_in"))


CODES_SQL = "[" + ", ".join(f"'{c}'" for c in RENDER_CODES) + "]"
MESSAGES_SQL = f"""messages AS (
  SELECT event_id, {CODES_SQL}[CAST(floor(k / 7) AS INTEGER) + 1] AS rendered_code,
    array_to_string(list_filter([
      CASE WHEN k < 30 THEN 'SQL3109N  The utility is beginning to load data from file "f' || CAST(event_id AS VARCHAR) || '.del".' END,
      {CODES_SQL}[CAST(floor(k / 7) AS INTEGER) + 1] || '  Message for event ' || CAST(event_id AS VARCHAR) || ' on ' || tabschema || '.' || tabname,
      CASE WHEN value >= 250 THEN 'SQL3110N  The utility has completed processing.' END], lambda x: x IS NOT NULL), chr(10)) AS text,
    CASE WHEN value < 400 THEN 0 ELSE 4 END AS rc_in
  FROM history WHERE operation = 'L')"""


@register("classify_messages", with_sql(HISTORY_SQL, MESSAGES_SQL) + """
SELECT event_id, code,
  CASE WHEN code = '' THEN 'none' WHEN regexp_matches(code, '^(SQL3109N|SQL3110N|SQL3149N|SQL3150N|SQL3153N)') THEN 'ignored'
       WHEN ends_with(code, 'N') THEN 'error' WHEN ends_with(code, 'W') THEN 'warning' ELSE 'critical' END AS severity,
  CASE WHEN rc_in = 0 AND regexp_matches(regexp_replace(text, '(?m)^SQL31(09|10|49|50|53)N.*$', '', 'g'), '(?m)^SQL3[2-9][0-9]*N')
       THEN 8 ELSE rc_in END AS rc,
  CASE WHEN t1 <> '' THEN t1 WHEN t2 <> '' THEN t2 WHEN t3 <> '' THEN t3 ELSE '' END AS detail
FROM (SELECT *, regexp_extract(text, '(?m)^(SQL[0-9]+[NWC])', 1) AS code,
        regexp_extract(text, '(?ms)^(SQL3109N.*)', 1) AS t1,
        regexp_extract(regexp_replace(text, '(?m)^SQL31(09|10|49|50|53)N.*(\\n|$)', '', 'g'), '(?ms)^(SQL3[2-9][0-9]*N.*)', 1) AS t2,
        regexp_extract(text, '(?ms)^(SQL0104N.*)', 1) AS t3
      FROM messages)""")
def q_classify_messages(spark, sf):
    m = _messages(spark, sf)
    code = msg.first_code(F.col("text"))
    return m.select("event_id", code.alias("code"), msg.severity(code).alias("severity"),
                    msg.escalated_rc(F.col("text"), F.col("rc_in")).alias("rc"),
                    msg.error_detail(F.col("text")).alias("detail"))


@register("action_from_code", with_sql(HISTORY_SQL, MESSAGES_SQL) + """
SELECT event_id, code, CASE code """ + " ".join(f"WHEN '{c}' THEN '{a}'" for c, a in msg.ACTIONS.items()) + f"""
  WHEN '' THEN '{msg.NO_CODE_ACTION}' ELSE '{msg.DEFAULT_ACTION}' END AS action
FROM (SELECT event_id, regexp_extract(rendered_code || '  resolver output', '(?m)^(SQL[0-9]+N)', 1) AS code FROM messages)""")
def q_action_from_code(spark, sf):
    """The integrity resolver's next step, chosen from the first error code of its output."""
    m = _messages(spark, sf)
    code = msg.first_error_code(F.concat(F.col("rendered_code"), F.lit("  resolver output")))
    return m.select("event_id", code.alias("code"), msg.action_for(code).alias("action"))
