"""Role bindings: which driver table plays which operational role.

* ``customer`` ⋈ ``nation`` ⋈ ``region`` = database inventory: host = region,
  instance = nation, database = market segment, entity = customer key.
* ``events`` = event history of those databases (``user_id`` = entity,
  ``purchase`` = backup, ``error`` = load), log records and config feeds.
* ``orders`` -> ``lineitem`` = parent/child event star.

Every derived column is a plain expression, so the DuckDB oracle can state the
same binding in SQL (see the ``*_SQL`` snippets).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..sources.text import read_lines, write_lines
from ..session import scratch_path
from ..functions.time import lit_ts

AS_OF_EVENTS = dt.datetime(2024, 1, 31, 0, 0, 0)
AS_OF_ORDERS = dt.datetime(2001, 12, 1, 0, 0, 0)
AS_OF_EVENTS_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
AS_OF_ORDERS_SQL = "TIMESTAMP '2001-12-01 00:00:00'"


def as_of_events():
    return lit_ts(AS_OF_EVENTS)


def as_of_orders():
    return lit_ts(AS_OF_ORDERS)


# ---------------------------------------------------------------- entities
def entities(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("c_custkey").alias("entity_id"),
                     F.lower("r_name").alias("host"),
                     F.lower(F.regexp_replace("n_name", "_", "")).alias("instance"),
                     F.upper("c_mktsegment").alias("dbname"),
                     F.col("c_name").alias("db_label"),
                     F.col("c_acctbal").alias("acctbal")))


ENTITIES_SQL = """entities AS (
  SELECT c.c_custkey AS entity_id, lower(r.r_name) AS host,
         lower(replace(n.n_name, '_', '')) AS instance, upper(c.c_mktsegment) AS dbname,
         c.c_name AS db_label, c.c_acctbal AS acctbal
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey)"""


# ---------------------------------------------------------------- history
def history(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    op = (F.when(F.col("event_type") == "purchase", "B").when(F.col("event_type") == "error", "L")
          .otherwise(F.upper(F.substring("event_type", 1, 1))))
    schema = F.concat(F.lit("S"), F.floor(k / 25).cast("int").cast("string"))
    name = F.concat(F.lit("T"), F.lpad(k.cast("string"), 2, "0"))
    h = ev.select(
        "event_id",
        F.col("user_id").alias("entity_id"),
        F.col("event_type"),
        op.alias("operation"),
        F.when(k < 80, "F").otherwise("I").alias("operationtype"),
        F.when(k < 50, "D").otherwise("f").alias("devicetype"),
        F.when(k >= 95, F.lit(-2036)).cast("int").alias("sqlcode"),
        F.col("ts").alias("start_time"),
        schema.alias("tabschema"),
        name.alias("tabname"),
        k.alias("k"),
        F.col("value"),
    )
    cmd = F.when(F.col("operation") == "L", F.concat(
        F.lit("load from f.del of del insert into "), F.col("tabschema"), F.lit("."), F.col("tabname"),
        F.when(F.col("k") < 40, F.lit(" non-recoverable")).otherwise(F.lit(" copy yes"))))
    return h.withColumn("cmd_text", cmd)


HISTORY_SQL = """history AS (
  SELECT *, CASE WHEN operation = 'L' THEN 'load from f.del of del insert into ' || tabschema || '.' || tabname ||
                 CASE WHEN k < 40 THEN ' non-recoverable' ELSE ' copy yes' END END AS cmd_text
  FROM (
    SELECT event_id, user_id AS entity_id, event_type,
           CASE WHEN event_type = 'purchase' THEN 'B' WHEN event_type = 'error' THEN 'L'
                ELSE upper(substr(event_type, 1, 1)) END AS operation,
           CASE WHEN k < 80 THEN 'F' ELSE 'I' END AS operationtype,
           CASE WHEN k < 50 THEN 'D' ELSE 'f' END AS devicetype,
           CAST(CASE WHEN k >= 95 THEN -2036 END AS INTEGER) AS sqlcode,
           ts AS start_time,
           'S' || CAST(CAST(floor(k / 25) AS INTEGER) AS VARCHAR) AS tabschema,
           'T' || lpad(CAST(k AS VARCHAR), 2, '0') AS tabname,
           k, value
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e))"""


# ---------------------------------------------------------------- rule files
# Fixed rule-file header (threshold file of the backup-age check).
THRESHOLD_HEADER = [
    "# Backup age thresholds: host:instance:database:dayOfWeek:kind:[warn;]crit",
    "# '*' matches anything; a threshold of 0 disables the check",
    "",
    "*:*:*:*:regular:48;120",
    "*:*:*:*:snapshot:0",
    "   europe:*:*:*:snapshot:72;168",
    "america:*:*:*:regular:0",
    "asia:*:AUTOMOBILE:*:regular:12;36",
    "*:*:*:excluded_table:regular:S0.T05, S1.T30",
    "america:*:*:excluded_table:regular:S2.T60",
    "africa:nation0:*:excluded_table:regular: S0.T07 ,S3.T99",
    "# per-nation overrides follow",
]
NATION_LINE_BASE = len(THRESHOLD_HEADER) + 1          # 13 + n_nationkey
DB_LINE_BASE = NATION_LINE_BASE + 25                  # 38 + (n_nationkey - 20)


def _nation_rule_lines(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    nr = n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.lower("r_name").alias("h"), F.lower(F.regexp_replace("n_name", "_", "")).alias("i"))
    key = F.col("n_nationkey")
    dow = (F.when(key < 5, "*").when(key < 10, "1-5").when(key < 15, "1,3,5")
           .when(key < 20, "2-4,6").otherwise("6-7"))
    thr = (F.when(key == 7, F.lit("0"))
           .when(key.between(16, 18), (key + 36).cast("string"))
           .otherwise(F.concat((key + 24).cast("string"), F.lit(";"), (key * 2 + 96).cast("string"))))
    per_nation = nr.select(
        (key + NATION_LINE_BASE).alias("line_no"),
        F.concat_ws(":", "h", "i", F.lit("*"), dow, F.lit("regular"), thr).alias("line"))
    per_db = nr.where(key >= 20).select(
        (key - 20 + DB_LINE_BASE).alias("line_no"),
        F.concat_ws(":", "h", "i", F.lit("machinery"), F.lit("*"), F.lit("regular"),
                    F.concat((key + 6).cast("string"), F.lit(";"), (key + 30).cast("string"))).alias("line"))
    return per_nation.unionByName(per_db)


def threshold_rule_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Render the rule file (header + per-nation lines) to shared storage and read it back."""
    header = spark.createDataFrame([(i + 1, s) for i, s in enumerate(THRESHOLD_HEADER)], "line_no int, line string")
    lines = header.unionByName(_nation_rule_lines(spark, sf).select(F.col("line_no").cast("int"), "line"))
    return read_lines(spark, write_lines(lines, scratch_path(spark, "rules-threshold")))


# Per-database overrides appended after the rule file (kept as a line table, not one text file,
# because their number grows with the inventory): one line per well-funded customer database.
OVERRIDE_LINE_BASE = 1000
OVERRIDE_MIN_BALANCE = 9000


def override_rule_lines(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    w = F.floor(F.col("c_acctbal") / 1000).cast("int")
    return (c.where(F.col("c_acctbal") > OVERRIDE_MIN_BALANCE)
             .join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
             .select(F.lit("db-overrides").alias("file"), (F.col("c_custkey").cast("long") + OVERRIDE_LINE_BASE).alias("line_no"),
                     F.concat_ws(":", F.lower("r_name"), F.lower(F.regexp_replace("n_name", "_", "")), F.lower("c_mktsegment"),
                                 F.lit("*"), F.lit("regular"),
                                 F.concat((w + 24).cast("string"), F.lit(";"), (w + 96).cast("string"))).alias("line")))


def _values_sql(rows: list[tuple]) -> str:
    def q(v):
        return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)


THRESHOLD_LINES_SQL = f"""rule_lines AS (
  SELECT * FROM (VALUES {_values_sql([(i + 1, s) for i, s in enumerate(THRESHOLD_HEADER)])}) t(line_no, line)
  UNION ALL
  SELECT n.n_nationkey + {NATION_LINE_BASE},
         concat_ws(':', lower(r.r_name), lower(replace(n.n_name, '_', '')), '*',
           CASE WHEN n.n_nationkey < 5 THEN '*' WHEN n.n_nationkey < 10 THEN '1-5' WHEN n.n_nationkey < 15 THEN '1,3,5'
                WHEN n.n_nationkey < 20 THEN '2-4,6' ELSE '6-7' END,
           'regular',
           CASE WHEN n.n_nationkey = 7 THEN '0'
                WHEN n.n_nationkey BETWEEN 16 AND 18 THEN CAST(n.n_nationkey + 36 AS VARCHAR)
                ELSE CAST(n.n_nationkey + 24 AS VARCHAR) || ';' || CAST(n.n_nationkey * 2 + 96 AS VARCHAR) END)
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL
  SELECT n.n_nationkey - 20 + {DB_LINE_BASE},
         concat_ws(':', lower(r.r_name), lower(replace(n.n_name, '_', '')), 'machinery', '*', 'regular',
                   CAST(n.n_nationkey + 6 AS VARCHAR) || ';' || CAST(n.n_nationkey + 30 AS VARCHAR))
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey >= 20
  UNION ALL
  SELECT c.c_custkey + {OVERRIDE_LINE_BASE},
         concat_ws(':', lower(r.r_name), lower(replace(n.n_name, '_', '')), lower(c.c_mktsegment), '*', 'regular',
                   CAST(CAST(floor(c.c_acctbal / 1000) AS INTEGER) + 24 AS VARCHAR) || ';' ||
                   CAST(CAST(floor(c.c_acctbal / 1000) AS INTEGER) + 96 AS VARCHAR))
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE c.c_acctbal > {OVERRIDE_MIN_BALANCE})"""

# DuckDB twin of sources.rules.parse_threshold_rules over ``rule_lines``.
PARSED_RULES_SQL = """parsed_rules AS (
  SELECT line_no,
         lower(trim(split_part(t, ':', 1))) AS host,
         lower(trim(split_part(t, ':', 2))) AS instance,
         lower(trim(split_part(t, ':', 3))) AS dbname,
         CASE WHEN is_excl THEN NULL ELSE regexp_replace(trim(split_part(t, ':', 4)), '\\s+', '', 'g') END AS dow,
         lower(trim(split_part(t, ':', 5))) AS kind,
         CASE WHEN is_excl THEN NULL WHEN contains(v, ';') THEN TRY_CAST(trim(split_part(v, ';', 1)) AS INTEGER) ELSE 0 END AS warn_h,
         CASE WHEN is_excl THEN NULL WHEN contains(v, ';') THEN TRY_CAST(trim(split_part(v, ';', 2)) AS INTEGER)
              ELSE TRY_CAST(v AS INTEGER) END AS crit_h,
         CASE WHEN is_excl THEN array_to_string(list_filter(list_transform(string_split(v, ','), lambda x: trim(x)), lambda x: x <> ''), ',') END AS excluded
  FROM (SELECT line_no, t, lower(trim(split_part(t, ':', 4))) = 'excluded_table' AS is_excl, trim(split_part(t, ':', 6)) AS v
        FROM (SELECT line_no, regexp_replace(line, '^[ \\t]+', '') AS t FROM rule_lines)
        WHERE t <> '' AND NOT starts_with(t, '#')))"""


def lookup_keys_sql(alias: str = "e") -> str:
    """DuckDB twin of operators.rules.lookup_keys: 4 rows per entity via UNION ALL."""
    return (f"SELECT {alias}.*, 0 AS spec, '*' AS k_host, '*' AS k_instance, '*' AS k_db FROM {{src}} {alias} UNION ALL "
            f"SELECT {alias}.*, 1, lower({alias}.host), '*', '*' FROM {{src}} {alias} UNION ALL "
            f"SELECT {alias}.*, 2, lower({alias}.host), lower({alias}.instance), '*' FROM {{src}} {alias} UNION ALL "
            f"SELECT {alias}.*, 3, lower({alias}.host), lower({alias}.instance), lower({alias}.dbname) FROM {{src}} {alias}")


def dow_matches_sql(spec: str, dow: str) -> str:
    return (f"(trim({spec}) = '*' OR coalesce(list_bool_or(list_transform(string_split(regexp_replace({spec}, '\\s+', '', 'g'), ','), "
            f"lambda x: CASE WHEN contains(x, '-') THEN {dow} >= TRY_CAST(split_part(x, '-', 1) AS INTEGER) "
            f"AND {dow} <= TRY_CAST(split_part(x, '-', 2) AS INTEGER) ELSE TRY_CAST(x AS INTEGER) = {dow} END)), false))")


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
