"""Relational building blocks over orders/lineitem/customer/part/supplier/nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import fold_db, fold_instance, is_numeric, name_of, qualify, schema_of
from ..operators.latest import latest_with_ties
from ..sources.tables import table
from .registry import register


@register("join_inner_multikey", """
WITH s AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS supplier_qty FROM lineitem GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, o.o_orderstatus, c.c_mktsegment, s.supplier_qty
FROM lineitem l JOIN s ON l.l_orderkey = s.l_orderkey AND l.l_suppkey = s.l_suppkey
     JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_join_inner_multikey(spark, sf):
    """Two-key join to a pre-aggregate, then a chain of one-key joins."""
    li = table(spark, sf, "lineitem")
    s = li.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("supplier_qty"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    j = (li.join(s, ["l_orderkey", "l_suppkey"]).join(o, li.l_orderkey == o.o_orderkey)
           .join(c, o.o_custkey == c.c_custkey))
    return j.select("l_orderkey", "l_linenumber", "l_suppkey", "o_orderstatus", "c_mktsegment", "supplier_qty")


@register("join_left_on_predicate", """
SELECT o.o_orderkey, count(l.l_orderkey) AS n_returned, c.c_name AS cust_name
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R'
              LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0
GROUP BY o.o_orderkey, c.c_name""")
def q_join_left_on_predicate(spark, sf):
    """Extra predicates live in the ON clause: every order survives, non-matches give 0 / NULL.
    The child side is pre-aggregated per key before the join (one row per order shuffled)."""
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    c = table(spark, sf, "customer")
    ret = li.where(F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    j = o.join(ret, o.o_orderkey == ret.l_orderkey, "left").join(
        c, (c.c_custkey == o.o_custkey) & (c.c_acctbal > 0), "left")
    return j.select("o_orderkey", F.coalesce(F.col("n"), F.lit(0)).alias("n_returned"), F.col("c_name").alias("cust_name"))


@register("join_semi_exists", """
SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'O')""")
def q_join_semi_exists(spark, sf):
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"))
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@register("join_semi_tuple_in", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE (l_orderkey, l_partkey, l_suppkey) IN (
  SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def q_join_semi_tuple_in(spark, sf):
    li = table(spark, sf, "lineitem")
    k = ["l_orderkey", "l_partkey", "l_suppkey"]
    sub = li.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select(*k)
    return li.join(sub, k, "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


EXCLUDED_PRIORITIES = ["1-URGENT", "5-LOW"]


@register("join_anti_exclusions", """
SELECT o_orderkey, o_orderpriority FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('1-URGENT'), ('5-LOW')) x(name) WHERE x.name = o.o_orderpriority)""")
def q_join_anti_exclusions(spark, sf):
    """NOT EXISTS against an inline VALUES list -> broadcast left-anti join."""
    o = table(spark, sf, "orders")
    excl = spark.createDataFrame([(p,) for p in EXCLUDED_PRIORITIES], "name string")
    return o.join(F.broadcast(excl), o.o_orderpriority == excl.name, "left_anti").select("o_orderkey", "o_orderpriority")


@register("latest_version_with_ties", """
SELECT o_custkey, o_orderkey, o_orderdate FROM orders o
WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)""")
def q_latest_version_with_ties(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return latest_with_ties(o, ["o_custkey"], "o_orderdate")


@register("top_n_ordered", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50""")
def q_top_n_ordered(spark, sf):
    """ORDER BY … FETCH FIRST n with a unique tiebreak -> TakeOrderedAndProject (per-partition top-n)."""
    return table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), F.col("o_orderkey").desc()) \
        .limit(50).select("o_orderkey", "o_totalprice")


IN_LIST = "1-URGENT,3-MEDIUM"


@register("filter_in_list", f"""
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ({', '.join(repr(x) for x in IN_LIST.split(','))})""")
def q_filter_in_list(spark, sf):
    """A comma list parameter becomes an IN filter that reaches the parquet scan."""
    values = [v.strip() for v in IN_LIST.split(",") if v.strip()]
    return table(spark, sf, "orders").where(F.col("o_orderpriority").isin(*values)).select("o_orderkey", "o_orderpriority")


@register("filter_like_flags", """
SELECT p_partkey, flags FROM (
  SELECT p_partkey, p_type, p_name, p_brand,
         CASE WHEN p_size >= 3 THEN 'Y' ELSE 'N' END || CASE WHEN p_retailprice >= 905 THEN 'Y' ELSE 'N' END AS flags FROM part)
WHERE p_type LIKE 'ECO%' AND upper(p_name) LIKE '%RING%' AND p_brand NOT LIKE 'Brand#1%' AND flags LIKE '%N%'""")
def q_filter_like_flags(spark, sf):
    """Prefix LIKE, %contains% on UPPER, NOT LIKE, and '%N%' over a per-constraint flag string."""
    p = table(spark, sf, "part")
    flags = F.concat(F.when(F.col("p_size") >= 3, "Y").otherwise("N"), F.when(F.col("p_retailprice") >= 905, "Y").otherwise("N"))
    return (p.select("p_partkey", "p_type", "p_name", "p_brand", flags.alias("flags"))
             .where(F.col("p_type").like("ECO%") & F.upper("p_name").like("%RING%") & ~F.col("p_brand").like("Brand#1%")
                    & F.col("flags").like("%N%"))
             .select("p_partkey", "flags"))


INCLUDE_RE, EXCLUDE_RE = r"^Customer#0000001", r"5$"


@register("filter_include_exclude", f"""
SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '{INCLUDE_RE}') AND NOT regexp_matches(c_name, '{EXCLUDE_RE}')""")
def q_filter_include_exclude(spark, sf):
    """Include regex first, then exclude regex."""
    c = table(spark, sf, "customer")
    return c.where(F.col("c_name").rlike(INCLUDE_RE)).where(~F.col("c_name").rlike(EXCLUDE_RE)).select("c_custkey")


@register("qualify_names", """
SELECT s.s_suppkey, trim(n.n_name) || '.' || trim(s.s_name) AS qualified,
       trim(n.n_name) AS schema_part, trim(s.s_name) AS name_part,
       upper(regexp_replace(n.n_name, '\\s+', '', 'g')) AS db_folded, lower(regexp_replace(n.n_name, '\\s+', '', 'g')) AS inst_folded,
       CASE WHEN contains(s.s_name, '.') THEN split_part(s.s_name, '.', 1) ELSE 'DEFAULT' END AS default_schema
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def q_qualify_names(spark, sf):
    """``TRIM(schema) || '.' || TRIM(name)``, split back, folded identifiers, default schema."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    q = qualify(F.col("n_name"), F.col("s_name"))
    return j.select("s_suppkey", q.alias("qualified"), schema_of(q, "DEFAULT").alias("schema_part"),
                    name_of(q).alias("name_part"), fold_db(F.col("n_name")).alias("db_folded"),
                    fold_instance(F.col("n_name")).alias("inst_folded"),
                    schema_of(F.col("s_name"), "DEFAULT").alias("default_schema"))


@register("is_numeric", """
SELECT c_custkey, 'name_suffix' AS kind, split_part(c_name, '#', 2) AS token,
       coalesce(regexp_matches(split_part(c_name, '#', 2), '^[0-9]+$'), false) AS is_num FROM customer
UNION ALL
SELECT c_custkey, 'segment', c_mktsegment, coalesce(regexp_matches(c_mktsegment, '^[0-9]+$'), false) FROM customer
UNION ALL
SELECT c_custkey, 'balance', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR),
       coalesce(regexp_matches(CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), '^[0-9]+$'), false) FROM customer""")
def q_is_numeric(spark, sf):
    """Unsigned digits only: '000123' yes, '-5' and 'BUILDING' no."""
    c = table(spark, sf, "customer")
    toks = F.array(
        F.struct(F.lit("name_suffix").alias("kind"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("token")),
        F.struct(F.lit("segment").alias("kind"), F.col("c_mktsegment").alias("token")),
        F.struct(F.lit("balance").alias("kind"), F.floor("c_acctbal").cast("long").cast("string").alias("token")))
    x = c.select("c_custkey", F.explode(toks).alias("t")).select("c_custkey", "t.kind", "t.token")
    return x.select("c_custkey", "kind", "token", is_numeric(F.col("token")).alias("is_num"))


# Fixed report labels (name = value lines) and their column names.
KV_KEYS = {"Supplier name": "supplier_name", "Nation key": "nation_key", "Account balance": "account_balance"}


@register("kv_pivot", """
SELECT s_suppkey AS block_id, s_name AS supplier_name, s_nationkey AS nation_key, s_acctbal AS account_balance FROM supplier""")
def q_kv_pivot(spark, sf):
    """Labelled ``key = value`` report blocks -> one wide row per block (known keys only)."""
    s = table(spark, sf, "supplier")
    report = s.select(F.col("s_suppkey").alias("block_id"), F.concat_ws(
        "\n", F.concat(F.lit("Supplier name = "), F.col("s_name")),
        F.concat(F.lit("Nation key = "), F.col("s_nationkey").cast("string")),
        F.concat(F.lit("  Account balance   = "), F.col("s_acctbal").cast("string")),
        F.lit("Unrelated line"), F.lit("Comment = ignored")).alias("text"))
    kv = report.select("block_id", F.explode(F.split("text", "\n")).alias("l")).select(
        "block_id", F.trim(F.regexp_extract("l", r"^([^=]+)=", 1)).alias("k"),
        F.trim(F.regexp_extract("l", r"=(.*)$", 1)).alias("v")).where(F.col("k") != "")
    wide = kv.groupBy("block_id").pivot("k", list(KV_KEYS)).agg(F.first("v"))
    return wide.select("block_id", F.col("Supplier name").alias("supplier_name"),
                       F.col("Nation key").try_cast("int").alias("nation_key"),
                       F.col("Account balance").try_cast("double").alias("account_balance"))


@register("scan_size_with_fallback", """
WITH tbl AS (SELECT c.c_nationkey AS nation_key, count(*) AS dbsize FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
             WHERE n.n_regionkey <> 2 GROUP BY 1),
     rep AS (SELECT s_nationkey AS nation_key, count(*) AS dbsize FROM supplier GROUP BY 1)
SELECT n.n_nationkey AS nation_key, coalesce(t.dbsize, r.dbsize) AS dbsize, CASE WHEN t.dbsize IS NOT NULL THEN 'table' WHEN r.dbsize IS NOT NULL THEN 'report' END AS source
FROM nation n LEFT JOIN tbl t ON t.nation_key = n.n_nationkey LEFT JOIN rep r ON r.nation_key = n.n_nationkey""")
def q_scan_size_with_fallback(spark, sf):
    """Size from the size table where it exists, else parsed from a ``name / Value : x`` report."""
    c, n, s = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "supplier")
    tbl = (c.join(n.where(F.col("n_regionkey") != 2), c.c_nationkey == n.n_nationkey)
            .groupBy(F.col("c_nationkey").alias("nation_key")).agg(F.count(F.lit(1)).alias("t_size")))
    report = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("cnt")).select(
        F.col("s_nationkey").alias("block"),
        F.concat(F.lit("Database size\n  Value : "), F.col("cnt").cast("string"), F.lit("\nDatabase capacity\n  Value : n/a")).alias("text"))
    parsed = report.select(F.col("block").alias("nation_key"),
                           F.regexp_extract("text", r"(?s)Database size\s*\n\s*Value\s*:\s*([0-9]+)", 1).cast("long").alias("r_size"))
    j = n.select(F.col("n_nationkey").alias("nation_key")).join(tbl, "nation_key", "left").join(parsed, "nation_key", "left")
    return j.select("nation_key", F.coalesce("t_size", "r_size").alias("dbsize"),
                    F.when(F.col("t_size").isNotNull(), "table").when(F.col("r_size").isNotNull(), "report").alias("source"))
