"""Corpus family: schema scripts rendered from suppliers, SQL text rendered from orders,
manifests from documents vs. labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as cp
from ..sources.tables import table
from .bindings import with_sql
from .registry import register

CHUNK_LINES = 1024
STEP = 20  # line numbers reserved per supplier in its nation's script


def _script_lines(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    q = F.concat(F.lit('"'), F.col("n_name"), F.lit('"."SUPP_'), F.col("s_suppkey").cast("string"), F.lit('"'))
    key = F.col("s_suppkey").cast("string")
    items = F.array(
        F.struct(F.lit(1).alias("j"), F.concat(F.lit("-- DDL Statements for Table "), q).alias("line")),
        F.struct(F.lit(2).alias("j"), F.concat(F.lit("CREATE TABLE "), q, F.lit(" (")).alias("line")),
        F.struct(F.lit(3).alias("j"), F.lit('  "S_NAME" VARCHAR(25) ,').alias("line")),
        F.struct(F.lit(4).alias("j"), F.lit("  -- balance in local currency").alias("line")),
        F.struct(F.lit(5).alias("j"), F.lit('  "S_ACCTBAL" DOUBLE )').alias("line")),
        F.struct(F.lit(6).alias("j"), F.lit('  IN "TS_DATA" ;').alias("line")),
        F.struct(F.lit(7).alias("j"), F.lit("").alias("line")),
        F.struct(F.lit(8).alias("j"), F.concat(F.lit("ALTER TABLE "), q, F.lit(' ADD PRIMARY KEY ("S_NAME");')).alias("line")),
        F.when(F.col("s_acctbal") < 1000, F.struct(F.lit(9).alias("j"), F.concat(
            F.lit("CREATE VIEW V_SUPP_"), key, F.lit(" AS SELECT * FROM "), q, F.lit(";")).alias("line"))),
        F.when(F.col("s_acctbal") > 8000, F.struct(F.lit(10).alias("j"), F.concat(
            F.lit('CREATE UNIQUE INDEX "'), F.col("n_name"), F.lit('"."IX_SUPP_'), key, F.lit('"')).alias("line"))),
        F.when(F.col("s_acctbal") > 8000, F.struct(F.lit(11).alias("j"), F.concat(
            F.lit("  ON "), q, F.lit(' ("S_NAME" ASC)')).alias("line"))),
        F.when(F.col("s_acctbal") > 8000, F.struct(F.lit(12).alias("j"), F.lit("  ALLOW REVERSE SCANS ;").alias("line"))),
    )
    return j.select(F.concat(F.lit("ddl/"), F.col("n_name"), F.lit(".sql")).alias("file"), "s_suppkey",
                    F.explode(F.filter(items, lambda x: x.isNotNull())).alias("it")) \
        .select("file", (F.col("s_suppkey") * STEP + F.col("it.j")).alias("line_no"), F.col("it.line").alias("line"))


def _q(alias="s", n="n"):
    return f"""'"' || {n}.n_name || '"."SUPP_' || CAST({alias}.s_suppkey AS VARCHAR) || '"'"""


_SCRIPT_PARTS = [
    (1, f"'-- DDL Statements for Table ' || {_q()}", "TRUE"),
    (2, f"'CREATE TABLE ' || {_q()} || ' ('", "TRUE"),
    (3, "'  \"S_NAME\" VARCHAR(25) ,'", "TRUE"),
    (4, "'  -- balance in local currency'", "TRUE"),
    (5, "'  \"S_ACCTBAL\" DOUBLE )'", "TRUE"),
    (6, "'  IN \"TS_DATA\" ;'", "TRUE"),
    (7, "''", "TRUE"),
    (8, f"'ALTER TABLE ' || {_q()} || ' ADD PRIMARY KEY (\"S_NAME\");'", "TRUE"),
    (9, f"'CREATE VIEW V_SUPP_' || CAST(s.s_suppkey AS VARCHAR) || ' AS SELECT * FROM ' || {_q()} || ';'", "s.s_acctbal < 1000"),
    (10, "'CREATE UNIQUE INDEX \"' || n.n_name || '\".\"IX_SUPP_' || CAST(s.s_suppkey AS VARCHAR) || '\"'", "s.s_acctbal > 8000"),
    (11, f"'  ON ' || {_q()} || ' (\"S_NAME\" ASC)'", "s.s_acctbal > 8000"),
    (12, "'  ALLOW REVERSE SCANS ;'", "s.s_acctbal > 8000"),
]
LINES_SQL = "lines AS (" + "\nUNION ALL ".join(
    f"SELECT 'ddl/' || n.n_name || '.sql' AS file, s.s_suppkey * {STEP} + {j} AS line_no, {expr} AS line "
    f"FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE {cond}" for j, expr, cond in _SCRIPT_PARTS) + ")"

KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(line, '{rx}') THEN '{k}'" for k, rx in cp.BLOCK_KINDS) + " END"
BLOCKS_SQL = f"""cls AS (
  SELECT *, CASE WHEN kind IS NOT NULL THEN line_no END AS beg_line,
         CASE WHEN regexp_matches(line, '{cp.END_MARKER}') THEN line_no END AS end_line
  FROM (SELECT *, {KIND_SQL} AS kind FROM lines)),
run AS (
  SELECT *, max(beg_line) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rb,
            max(end_line) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS re
  FROM cls),
members AS (
  SELECT * FROM run WHERE rb IS NOT NULL AND (re IS NULL OR re < rb) AND trim(line) <> '' AND NOT starts_with(trim(line), '--')),
blocks AS (
  SELECT m.file, m.rb AS begin_line, b.kind, regexp_replace(regexp_extract(b.line, '{cp.NAME_RE}', 1), '"', '', 'g') AS tok,
         count(*) AS n_lines
  FROM members m JOIN cls b ON b.file = m.file AND b.line_no = m.rb
  GROUP BY m.file, m.rb, b.kind, b.line),
objects AS (
  SELECT file, begin_line, kind,
         CASE WHEN contains(tok, '.') THEN split_part(tok, '.', 1) ELSE '{cp.UNQUALIFIED}' END AS schema,
         CASE WHEN contains(tok, '.') THEN split_part(tok, '.', 2) ELSE tok END AS name, n_lines
  FROM blocks)"""


@register("extract_blocks", with_sql(LINES_SQL, BLOCKS_SQL) + "SELECT * FROM objects")
def q_extract_blocks(spark, sf):
    return cp.extract_blocks(_script_lines(spark, sf), CHUNK_LINES)


@register("object_inventory", with_sql(LINES_SQL, BLOCKS_SQL) +
          "SELECT kind, schema, count(*) AS n_objects, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM objects GROUP BY kind, schema")
def q_object_inventory(spark, sf):
    b = cp.extract_blocks(_script_lines(spark, sf), CHUNK_LINES)
    return b.groupBy("kind", "schema").agg(F.count(F.lit(1)).alias("n_objects"), F.sum("n_lines").cast("long").alias("n_lines"))


# ------------------------------------------------------------------ SQL text
def _statements(spark, sf):
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("FETCH C1 INTO :H"), F.col("o_orderkey").cast("string"))) \
        .otherwise(F.concat(
            F.lit("select c.a, s.b\n  from TPCH.CUST_"), F.col("o_custkey").cast("string"), F.lit(" c, STATUS_"),
            F.col("o_orderstatus"), F.lit(" s\n  left join PRIO_"), F.substring("o_orderpriority", 1, 1),
            F.lit(" p on c.k = p.k where c.z = 1 order by 1")))
    return o.select(F.col("o_orderkey").alias("stmt_id"), text.alias("stmt"))


STMTS_SQL = """stmts AS (
  SELECT o_orderkey AS stmt_id,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'FETCH C1 INTO :H' || CAST(o_orderkey AS VARCHAR)
         ELSE 'select c.a, s.b' || chr(10) || '  from TPCH.CUST_' || CAST(o_custkey AS VARCHAR) || ' c, STATUS_' || o_orderstatus ||
              ' s' || chr(10) || '  left join PRIO_' || substr(o_orderpriority, 1, 1) || ' p on c.k = p.k where c.z = 1 order by 1' END AS stmt
  FROM orders)"""
REFS_SQL = f"""refs AS (
  SELECT DISTINCT stmt_id, table_ref FROM (
    SELECT stmt_id, unnest(list_filter(flatten(list_transform(
             list_filter(string_split(regexp_replace(regexp_replace(s, '\\b(FROM|JOIN)\\b', '|@', 'g'), '{cp.CUT_KEYWORDS}', '|', 'g'), '|'),
                         lambda x: starts_with(x, '@')),
             lambda seg: list_transform(string_split(substr(seg, 2), ','), lambda t: split_part(trim(t), ' ', 1)))),
           lambda x: x <> '')) AS table_ref
    FROM (SELECT stmt_id, upper(regexp_replace(stmt, '\\s+', ' ', 'g')) AS s FROM stmts)
    WHERE NOT regexp_matches(s, '{cp.SKIP_STATEMENTS}')))"""


@register("sql_table_refs", with_sql(STMTS_SQL, REFS_SQL) + "SELECT table_ref, count(*) AS n_statements FROM refs GROUP BY table_ref")
def q_sql_table_refs(spark, sf):
    r = cp.table_refs(_statements(spark, sf), "stmt_id", "stmt")
    return r.groupBy("table_ref").agg(F.count(F.lit(1)).alias("n_statements"))


SCHEMAS = ["TPCH", "STAGE"]


def _object_catalog(spark, sf):
    c = table(spark, sf, "customer").where(F.col("c_acctbal") >= 0).select(
        F.lit("TPCH").alias("schema"), F.concat(F.lit("CUST_"), F.col("c_custkey").cast("string")).alias("name"))
    o = table(spark, sf, "orders")
    st = o.select(F.lit("TPCH").alias("schema"), F.concat(F.lit("STATUS_"), F.col("o_orderstatus")).alias("name")).distinct()
    pr = o.where(F.substring("o_orderpriority", 1, 1) <= "3").select(
        F.lit("STAGE").alias("schema"), F.concat(F.lit("PRIO_"), F.substring("o_orderpriority", 1, 1)).alias("name")).distinct()
    return c.unionByName(st).unionByName(pr)


@register("missing_objects", with_sql(STMTS_SQL, REFS_SQL) + f""",
cat AS (
  SELECT 'TPCH' AS schema, 'CUST_' || CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_acctbal >= 0
  UNION SELECT 'TPCH', 'STATUS_' || o_orderstatus FROM orders
  UNION SELECT 'STAGE', 'PRIO_' || substr(o_orderpriority, 1, 1) FROM orders WHERE substr(o_orderpriority, 1, 1) <= '3'),
need AS (
  SELECT DISTINCT split_part(table_ref, '.', 1) AS schema, split_part(table_ref, '.', 2) AS name FROM refs WHERE contains(table_ref, '.')
  UNION SELECT s.schema, r.table_ref FROM refs r, (VALUES {', '.join(f"('{s}')" for s in SCHEMAS)}) s(schema) WHERE NOT contains(r.table_ref, '.'))
SELECT schema, name FROM need WHERE (schema, name) NOT IN (SELECT schema, name FROM cat)""")
def q_missing_objects(spark, sf):
    refs = cp.table_refs(_statements(spark, sf), "stmt_id", "stmt").select("table_ref").distinct()
    return cp.missing_objects(refs, _object_catalog(spark, sf), SCHEMAS)


# ------------------------------------------------------------------ manifest vs catalog
def _manifest(spark, sf):
    d = table(spark, sf, "documents")
    header = F.concat(F.lit("CREATOR="), F.col("source"), F.lit(" NAME=DOC"), F.col("doc_id").cast("string"),
                      F.lit(" TOKEN="), F.col("lang"), F.lit(" PATH=/bind/"), F.col("source"), F.lit("/"))
    h = d.select(header.alias("h"))
    # header record -> manifest fields (creator, name, token, path)
    return h.select(
        F.regexp_extract("h", r"CREATOR=(\S+)", 1).alias("creator"),
        F.regexp_extract("h", r"NAME=DOC([0-9]+)", 1).cast("long").alias("doc_id"),
        F.regexp_extract("h", r"TOKEN=(\S+)", 1).alias("token"),
        F.regexp_extract("h", r"PATH=(\S+)", 1).alias("path"))


@register("manifest_reconcile", """
WITH m AS (SELECT doc_id, lang AS token, '/bind/' || source || '/' AS path FROM documents),
     c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN '/alt/' ELSE '/bind/' END AS c_path,
                  CASE WHEN quality = 1 THEN 'en' ELSE 'fr' END AS c_token FROM labels),
     j AS (SELECT m.*, c.c_path, c.c_token FROM m LEFT JOIN c USING (doc_id))
SELECT doc_id, 'missing_artifact' AS finding FROM j WHERE c_path IS NULL
UNION ALL SELECT doc_id, CASE WHEN starts_with(c_path, '/alt/') THEN 'alternate_folder' ELSE 'path_mismatch' END
  FROM j WHERE c_path IS NOT NULL AND NOT starts_with(path, c_path)
UNION ALL SELECT doc_id, 'token_mismatch' FROM j WHERE c_token IS NOT NULL AND c_token <> token""")
def q_manifest_reconcile(spark, sf):
    lab = table(spark, sf, "labels")
    cat = lab.select("doc_id", F.when(F.col("toxic") == 1, "/alt/").otherwise("/bind/").alias("path"),
                     F.when(F.col("quality") == 1, "en").otherwise("fr").alias("token"))
    return cp.reconcile(_manifest(spark, sf), cat, "doc_id")
