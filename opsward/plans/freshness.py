"""Freshness / state SLA family bound to the inventory (customers) and history (events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dow import dow_matches, iso_dow
from ..functions.time import from_ts14, iso_text, to_ts14, whole_hours
from ..operators import status as st
from ..operators.latest import events_after, first_finding, latest_per_entity
from ..operators.rules import resolve
from ..sources.rules import parse_availability_rules, parse_retention_rules, parse_threshold_rules
from ..sources.tables import table
from .bindings import (AS_OF_EVENTS_SQL, ENTITIES_SQL, HISTORY_SQL, OVERRIDE_LINE_BASE, PARSED_RULES_SQL, THRESHOLD_LINES_SQL,
                       _values_sql, as_of_events, dow_matches_sql, entities, history, lookup_keys_sql,
                       override_rule_lines, threshold_rule_lines, with_sql)
from .registry import register

KINDS = ("regular", "snapshot")
DEVICE = {"regular": "D", "snapshot": "f"}

# Thresholds of a check without any rule (hours), and activation states without a rule.
DEFAULT_WARN, DEFAULT_CRIT = 48, 120
DEFAULT_THRESHOLDS = {"warn_h": DEFAULT_WARN, "crit_h": DEFAULT_CRIT, "dow": "*"}
DEFAULT_STATES = {"warn_state": "IMPLICIT", "crit_state": "INACTIVE"}


# ----------------------------------------------------------------- Spark side
def parsed_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rule file (read from shared storage) followed by the per-database override lines."""
    lines = threshold_rule_lines(spark, sf).unionByName(override_rule_lines(spark, sf))
    return parse_threshold_rules(lines).drop("file")


def entity_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS])))


def resolved_thresholds(spark: SparkSession, sf: str, rules: DataFrame | None = None) -> DataFrame:
    rules = parsed_rules(spark, sf) if rules is None else rules
    thr = rules.where(F.col("excluded").isNull() & F.col("kind").isin(*KINDS))
    return resolve(entity_kinds(spark, sf), thr, ["entity_id", "host", "instance", "dbname"],
                   ["warn_h", "crit_h", "dow"], match_cols=["kind"], defaults=DEFAULT_THRESHOLDS)


def resolved_exclusions(spark: SparkSession, sf: str, rules: DataFrame | None = None) -> DataFrame:
    rules = parsed_rules(spark, sf) if rules is None else rules
    ex = rules.where(F.col("excluded").isNotNull())
    return resolve(entity_kinds(spark, sf), ex, ["entity_id", "host", "instance", "dbname"], ["excluded"],
                   match_cols=["kind"], how="concat").where(F.col("excluded").isNotNull())


def latest_backups(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf).where((F.col("operation") == "B") & F.col("sqlcode").isNull()
                                 & F.col("devicetype").isin(*DEVICE.values()))
    h = h.withColumn("kind", F.when(F.col("devicetype") == "D", "regular").otherwise("snapshot"))
    return latest_per_entity(h, ["entity_id", "kind"], "start_time", "event_id").withColumnRenamed("start_time", "latest_time")


def schedule(spark: SparkSession, sf: str, rules: DataFrame | None = None) -> DataFrame:
    r = resolved_thresholds(spark, sf, rules)
    eligible = dow_matches(F.col("dow"), iso_dow(as_of_events()))
    return r.select("entity_id", "host", "instance", "dbname", "kind", "line_no", "warn_h", "crit_h", "dow",
                    eligible.alias("eligible"),
                    st.schedule_state(F.col("crit_h"), eligible).alias("schedule"))


def invalidated(spark: SparkSession, sf: str, rules: DataFrame | None = None) -> DataFrame:
    """First non-recoverable load after the last full backup, per entity and kind, apart from excluded tables."""
    ev = _unrecoverable_after(spark, sf).withColumn("table_name", F.concat_ws(".", "tabschema", "tabname"))
    ev = ev.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS])))
    ex = resolved_exclusions(spark, sf, rules).select("entity_id", "kind", "excluded")
    kept = (ev.join(ex, ["entity_id", "kind"], "left")
              .where(~F.coalesce(F.array_contains(F.split("excluded", ","), F.col("table_name")), F.lit(False))))
    msg = F.concat(F.lit("backup image of "), iso_text(F.col("backup_time")),
                   F.lit(" has no value since a non-recoverable load into "), F.col("table_name"),
                   F.lit(" on "), iso_text(F.col("start_time")))
    return first_finding(kept.withColumn("msg", msg), ["entity_id", "kind"], F.col("msg"), "finding")


def full_status(spark: SparkSession, sf: str) -> DataFrame:
    """One status per check that is not switched off: off days are OK without a look at the backup, an invalidated
    backup is CRITICAL whatever its age, else the age decides. The rule file is rendered and read once."""
    rules = parsed_rules(spark, sf)
    s = schedule(spark, sf, rules).where(F.col("schedule") != "disabled")
    j = s.join(latest_backups(spark, sf), ["entity_id", "kind"], "left").join(invalidated(spark, sf, rules), ["entity_id", "kind"], "left")
    age = whole_hours(F.col("latest_time"), as_of_events())
    off, bad = F.col("schedule") == "not_today", F.col("finding").isNotNull()
    code = F.when(off, 0).when(bad, 2).otherwise(st.freshness_code(age, F.col("warn_h"), F.col("crit_h")))
    reason = F.when(off, "off_day").when(bad, "invalidated").when(age.isNull(), "never").otherwise("age")
    message = (F.when(off, F.concat(F.lit("No check configured for today for a "), F.col("kind"), F.lit(" backup")))
               .when(bad, F.concat_ws(" ", "kind", "finding"))
               .when(age.isNull(), F.concat(F.col("kind"), F.lit(" backup never taken")))
               .otherwise(F.concat(age.cast("string"), F.lit(" hours since last full backup at "), iso_text(F.col("latest_time")))))
    return j.select("entity_id", "host", "instance", "dbname", "kind", age.alias("age_hours"), "warn_h", "crit_h",
                    code.cast("int").alias("status_code"), st.status_text(code).alias("status_text"), reason.alias("reason"), message.alias("message"))


def status_frame(spark: SparkSession, sf: str) -> DataFrame:
    s = schedule(spark, sf).where(F.col("schedule") == "active")
    lb = latest_backups(spark, sf)
    j = s.join(lb, ["entity_id", "kind"], "left")
    age = whole_hours(F.col("latest_time"), as_of_events())
    code = st.freshness_code(age, F.col("warn_h"), F.col("crit_h"))
    return j.select("entity_id", "host", "instance", "dbname", "kind", "latest_time",
                    age.alias("age_hours"), "warn_h", "crit_h", code.alias("status_code"),
                    st.status_text(code).alias("status_text"))


@register("rules_parse")
def q_rules_parse(spark, sf):
    return parsed_rules(spark, sf)


@register("rule_resolve")
def q_rule_resolve(spark, sf):
    return resolved_thresholds(spark, sf).select("entity_id", "kind", "line_no", "warn_h", "crit_h", "dow")


@register("rule_defaults")
def q_rule_defaults(spark, sf):
    """Per-database lines only: every other check falls back to the defaults instead of vanishing."""
    rules = parse_threshold_rules(override_rule_lines(spark, sf)).drop("file")
    return resolved_thresholds(spark, sf, rules).select("entity_id", "kind", "line_no", "warn_h", "crit_h", "dow")


@register("exclusions_resolve")
def q_exclusions_resolve(spark, sf):
    return resolved_exclusions(spark, sf).select("entity_id", "kind", "excluded")


@register("dow_eligibility")
def q_dow_eligibility(spark, sf):
    r = resolved_thresholds(spark, sf).where(F.col("kind") == "regular").select("entity_id", "line_no", "dow")
    b = history(spark, sf).where(F.col("operation") == "B").select("event_id", "entity_id", "start_time")
    d = iso_dow(F.to_date("start_time"))
    return b.join(r, "entity_id").select("event_id", "entity_id", "line_no", "dow",
                                         d.alias("day_of_week"), dow_matches(F.col("dow"), d).alias("eligible"))


@register("latest_per_entity")
def q_latest_per_entity(spark, sf):
    return latest_backups(spark, sf).select("entity_id", "kind", "latest_time", "event_id")


@register("age_hours")
def q_age_hours(spark, sf):
    lb = latest_backups(spark, sf)
    t14 = to_ts14(F.col("latest_time"))
    parsed = from_ts14(t14)
    return lb.select("entity_id", "kind", t14.alias("ts14"), iso_text(parsed).alias("iso"),
                     whole_hours(parsed, as_of_events()).alias("age_hours"))


def _last_full_backup(spark, sf):
    full = history(spark, sf).where((F.col("operation") == "B") & F.col("operationtype").isin("F", "N"))
    return full.groupBy("entity_id").agg(F.max("start_time").alias("backup_time"))


def _unrecoverable_after(spark, sf):
    loads = history(spark, sf).where((F.col("operation") == "L")
                                     & F.upper(F.col("cmd_text")).like("%NON-RECOVERABLE%"))
    return events_after(loads, _last_full_backup(spark, sf), ["entity_id"], "start_time", "backup_time")


@register("events_after_latest")
def q_events_after_latest(spark, sf):
    return _unrecoverable_after(spark, sf).select(
        "entity_id", "event_id", "start_time", "backup_time",
        F.concat_ws(".", "tabschema", "tabname").alias("table_name"))


@register("freshness_invalidated")
def q_freshness_invalidated(spark, sf):
    found = invalidated(spark, sf).where(F.col("kind") == "regular")
    return found.select("entity_id", F.lit(2).alias("status_code"), F.lit("CRITICAL").alias("status_text"),
                        F.concat(F.lit("regular "), F.col("finding")).alias("message"))


@register("freshness_full")
def q_freshness_full(spark, sf):
    """Age, invalidation and off days merged: one status per check."""
    return full_status(spark, sf).select("entity_id", "kind", "age_hours", "warn_h", "crit_h", "status_code", "status_text", "reason", "message")


@register("freshness_schedule")
def q_freshness_schedule(spark, sf):
    return schedule(spark, sf).select("entity_id", "kind", "warn_h", "crit_h", "dow", "eligible", "schedule")


@register("freshness_status")
def q_freshness_status(spark, sf):
    return status_frame(spark, sf).select("entity_id", "kind", "age_hours", "warn_h", "crit_h",
                                          "status_code", "status_text")


@register("freshness_status_fixed")
def q_freshness_status_fixed(spark, sf):
    b = history(spark, sf).where(F.col("operation") == "B")
    last = b.groupBy("entity_id").agg(F.max("start_time").alias("latest_time"))
    e = entities(spark, sf).select("entity_id")
    age = whole_hours(F.col("latest_time"), as_of_events())
    code = st.fixed_freshness_code(age)
    j = e.join(last, "entity_id", "left")
    h = F.coalesce(age.cast("string"), F.lit("0"))
    # the simple check decides on 100/200 hours but prints 48;120 as its thresholds
    line = st.status_line(code, F.concat(F.lit("Age_last_backup_"), F.col("entity_id").cast("string")),
                          F.concat(F.lit("age_hours="), h, F.lit(";48;120;0;")),
                          F.concat(h, F.lit(" hours since last "), F.col("entity_id").cast("string"), F.lit(" full backup")))
    return j.select("entity_id", age.alias("age_hours"), code.alias("status_code"),
                    st.status_text(code).alias("status_text"), line.alias("line"))


@register("status_lines")
def q_status_lines(spark, sf):
    """The line of every check that is not switched off, off days and invalidated backups included."""
    s = full_status(spark, sf)
    service = F.concat_ws("_", F.lit("Age_last_backup"), "kind", F.regexp_replace("host", " ", ""), "instance",
                          "dbname", F.col("entity_id").cast("string"))
    limits = F.concat_ws(";", "warn_h", "crit_h", F.lit("0;"))
    # fixed forms: an off day shows no age, an invalidated backup shows age 0 and the default limits
    perf = F.concat(F.lit("age_hours="), F.when(F.col("reason") == "off_day", limits)
                    .when(F.col("reason") == "invalidated", F.lit(f"0;{DEFAULT_WARN};{DEFAULT_CRIT};0;"))
                    .otherwise(F.concat_ws(";", F.coalesce("age_hours", F.lit(0)), limits)))
    return s.select("entity_id", "kind", "status_code", "reason",
                    st.status_line(F.col("status_code"), service, perf, F.col("message")).alias("line"))


@register("overall_status")
def q_overall_status(spark, sf):
    """Off days count as OK checks, invalidated backups as CRITICAL ones."""
    return st.overall(full_status(spark, sf), ["host"])


# ------------------------------------------------------------ state & quiesce
# Fixed availability rule file (host:instance:database:sensor:[warn;]crit).
AVAILABILITY_RULES = [
    "# availability thresholds, ordered to less OK: EXPLICIT, IMPLICIT, INACTIVE",
    "*:*:*:availability:IMPLICIT;INACTIVE",
    "europe:*:*:availability:0",
    "asia:*:*:availability:INACTIVE",
    "america:nation1:*:availability:EXPLICIT;INACTIVE",
    "africa:*:*:availability:INACTIVE;IMPLICIT",
    "africa:nation5:building:availability:0;0",
]

# Latest event type per entity -> activation state / quiesce facts.
STATE_OF_EVENT = {"signup": "EXPLICIT", "purchase": "EXPLICIT", "click": "IMPLICIT", "view": "UNKNOWN",
                  "error": "INACTIVE"}


def _latest_event_type(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy(F.col("user_id").alias("entity_id")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))


def _state_expr(col):
    e = None
    for k, v in STATE_OF_EVENT.items():
        e = F.when(col == k, F.lit(v)) if e is None else e.when(col == k, F.lit(v))
    return e


def _rules_df(spark, lines):
    return spark.createDataFrame([(None, i + 1, s) for i, s in enumerate(lines)], "file string, line_no int, line string")


@register("state_status")
def q_state_status(spark, sf):
    rules = parse_availability_rules(_rules_df(spark, AVAILABILITY_RULES)).where(F.col("sensor") == "availability")
    ent = entities(spark, sf)
    res = resolve(ent, rules, ["entity_id", "host", "instance", "dbname"], ["warn_state", "crit_state"], defaults=DEFAULT_STATES)
    j = res.where(~((F.col("warn_state") == "0") & (F.col("crit_state") == "0"))) \
        .join(_latest_event_type(spark, sf), "entity_id", "left")
    state = _state_expr(F.col("last_event"))
    code = st.activation_code(state, F.col("warn_state"), F.col("crit_state"))
    return j.select("entity_id", "warn_state", "crit_state", state.alias("state"), code.alias("status_code"),
                    st.status_text(code).alias("status_text"),
                    st.activation_text(state, F.col("warn_state"), F.col("crit_state"), code).alias("message"))


@register("quiesce_status")
def q_quiesce_status(spark, sf):
    j = entities(spark, sf).select("entity_id").join(_latest_event_type(spark, sf), "entity_id", "left")
    le = F.col("last_event")
    activated = F.when(le.isNull(), F.lit(None).cast("boolean")).otherwise(le != "error")
    code = st.quiesce_code(activated, le == "view", le == "purchase")
    return j.select("entity_id", code.alias("status_code"), st.status_text(code).alias("status_text"),
                    st.quiesce_text(code).alias("message"))


@register("state_lines")
def q_state_lines(spark, sf):
    """The monitoring lines of both state checks; a database whose thresholds are 0 and 0 has none for its activation."""
    e = entities(spark, sf).select("entity_id", "host", "instance", "dbname")
    out = None
    # fixed forms of the two checks: service, measure and its limits
    for query, service, perf in ((q_state_status, "Activation_status", ("activation_status=", ";;2")), (q_quiesce_status, "Quiesce_status", ("quiesce_status=", ";1;2"))):
        j = query(spark, sf).select("entity_id", "status_code", "message").join(e, "entity_id")
        code = F.col("status_code")
        line = st.status_line(code, F.concat_ws("_", F.lit(service), F.regexp_replace("host", " ", ""), "instance", "dbname"),
                              F.concat(F.lit(perf[0]), code.cast("string"), F.lit(perf[1])), F.concat_ws(" ", "dbname", "message"))
        one = j.select("entity_id", F.lit(service).alias("service"), "status_code", line.alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


@register("decision_table")
def q_decision_table(spark, sf):
    e = entities(spark, sf)
    j = e.join(_latest_event_type(spark, sf), "entity_id", "left")
    requested = F.when(F.col("acctbal") < 0, "OFFLINE").otherwise("ONLINE")
    log_method = (F.when(F.col("dbname").isin("AUTOMOBILE", "BUILDING"), "ARCHIVE")
                  .when(F.col("dbname") == "FURNITURE", "LOGRETAIN").otherwise("CIRCULAR"))
    activation = F.coalesce(_state_expr(F.col("last_event")), F.lit("INACTIVE"))
    force = F.col("acctbal") > 9000
    utility = (F.when(F.col("last_event") == "purchase", "BACKUP").when(F.col("last_event") == "error", "LOAD")
               .otherwise("none"))
    chosen, err = st.backup_decision(requested, log_method, activation, force, utility)
    return j.select("entity_id", requested.alias("requested"), log_method.alias("log_method"),
                    activation.alias("activation"), force.alias("force"), utility.alias("utility"),
                    chosen.alias("chosen_mode"), err.alias("error_code"))


# An invented rule set that covers every case: relative and absolute extras, copies given or left to the comment or the
# default, instance and database lines, and a host (africa) without a line.
RETENTION_RULES = [
    "asia:*:*:0:+3",
    "asia:nation8:*:0:+5",
    "europe:*:*:6:9",
    "europe:nation6:*:4:4",
    "america:*:*:7:+1",
    "america:nation2:household:3:20",
    "middle east:*:*:0:11",
]
# Names that always keep one copy, as patterns (SQL LIKE).
SINGLE_COPY_PATTERNS = ["Customer#%77", "Customer#00000001%"]
DEFAULT_COPIES = 1
DEFAULT_EXTRA = 2


@register("retention_resolve")
def q_retention_resolve(spark, sf):
    """Copies to keep, and copies that the history keeps: ``+n`` adds to the copies found, ``n`` replaces them."""
    rules = parse_retention_rules(_rules_df(spark, RETENTION_RULES))
    res = resolve(entities(spark, sf), rules, ["entity_id", "host", "instance", "dbname", "db_label", "acctbal"], ["copies", "extra"])
    extra = F.coalesce(F.col("extra"), F.lit(f"+{DEFAULT_EXTRA}"))
    rel = F.when(extra.startswith("+"), F.substr(extra, F.lit(2)).try_cast("int"))
    absolute = F.when(~extra.startswith("+"), extra.try_cast("int"))
    by_rule = F.col("copies")
    single = F.lit(False)
    for p in SINGLE_COPY_PATTERNS:
        single = single | F.col("db_label").like(p)
    comment = F.when(F.col("acctbal") > 5000,
                     F.concat(F.lit("BACKUP RET="), F.floor(F.col("acctbal") / 1000).cast("int").cast("string")))
    from_comment = F.regexp_extract(F.coalesce(comment, F.lit("")), r"BACKUP RET=\s*([0-9]+)", 1).try_cast("int")
    copies = (F.when(single, F.lit(1))
              .when(by_rule > 0, by_rule)
              .when(F.coalesce(from_comment, F.lit(0)) > 0, from_comment)
              .otherwise(F.lit(DEFAULT_COPIES)))
    copies_db = F.when(single, F.lit(1)).when(absolute.isNotNull(), absolute).otherwise(copies + F.coalesce(rel, F.lit(DEFAULT_EXTRA)))
    return res.select("entity_id", "line_no", copies.alias("copies"), copies_db.alias("copies_db"))


# ----------------------------------------------------------------- oracle SQL
AS_OF = AS_OF_EVENTS_SQL

RULE_CTES = [THRESHOLD_LINES_SQL, PARSED_RULES_SQL]

RESOLVED_SQL = """entity_kinds AS (SELECT e.*, kd.kind FROM entities e, (VALUES ('regular'), ('snapshot')) kd(kind)),
ek_keys AS (""" + lookup_keys_sql("e").replace("{src}", "entity_kinds") + """),
thr_cand AS (
  SELECT k.entity_id, k.host, k.instance, k.dbname, k.kind, k.spec, r.line_no,
         CASE WHEN r.line_no IS NULL THEN 48 ELSE r.warn_h END AS warn_h,
         CASE WHEN r.line_no IS NULL THEN 120 ELSE r.crit_h END AS crit_h,
         CASE WHEN r.line_no IS NULL THEN '*' ELSE r.dow END AS dow
  FROM ek_keys k LEFT JOIN (SELECT * FROM parsed_rules WHERE excluded IS NULL) r
    ON r.host = k.k_host AND r.instance = k.k_instance AND r.dbname = k.k_db AND r.kind = k.kind),
resolved AS (
  SELECT * EXCLUDE (rn, spec) FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, kind ORDER BY (line_no IS NULL)::INT, spec DESC, line_no DESC) rn FROM thr_cand)
  WHERE rn = 1)"""

EXCL_SQL = """excl_cand AS (
  SELECT k.entity_id, k.kind, k.spec, r.line_no, r.excluded
  FROM ek_keys k JOIN parsed_rules r
    ON r.host = k.k_host AND r.instance = k.k_instance AND r.dbname = k.k_db AND r.kind = k.kind
  WHERE r.excluded IS NOT NULL),
excl_level AS (
  SELECT entity_id, kind, spec, arg_max(excluded, line_no) AS excluded FROM excl_cand GROUP BY ALL),
exclusions AS (
  SELECT entity_id, kind, string_agg(excluded, ',' ORDER BY spec, excluded) AS excluded FROM excl_level GROUP BY ALL)"""

LATEST_SQL = """latest AS (
  SELECT entity_id, kind, start_time AS latest_time, event_id FROM (
    SELECT *, CASE WHEN devicetype = 'D' THEN 'regular' ELSE 'snapshot' END AS kind,
           row_number() OVER (PARTITION BY entity_id, CASE WHEN devicetype = 'D' THEN 'regular' ELSE 'snapshot' END
                              ORDER BY start_time DESC, event_id DESC) rn
    FROM history WHERE operation = 'B' AND sqlcode IS NULL AND devicetype IN ('D', 'f'))
  WHERE rn = 1)"""

AGE = f"(epoch_us({AS_OF}) - epoch_us({{t}})) // 3600000000"

SCHEDULE_SQL = f"""schedule AS (
  SELECT *, CASE WHEN crit_h IS NULL OR crit_h = 0 THEN 'disabled' WHEN NOT eligible THEN 'not_today' ELSE 'active' END AS schedule
  FROM (SELECT *, {dow_matches_sql('dow', f'isodow({AS_OF})')} AS eligible FROM resolved))"""

STATUS_SQL = f"""status AS (
  SELECT s.entity_id, s.host, s.instance, s.dbname, s.kind, l.latest_time,
         {AGE.format(t='l.latest_time')} AS age_hours, s.warn_h, s.crit_h
  FROM schedule s LEFT JOIN latest l ON s.entity_id = l.entity_id AND s.kind = l.kind
  WHERE s.schedule = 'active'),
status2 AS (
  SELECT *, CASE WHEN age_hours IS NULL THEN 2 WHEN age_hours <= warn_h THEN 0 WHEN age_hours <= crit_h THEN 1 ELSE 2 END AS status_code
  FROM status),
status3 AS (
  SELECT *, CASE status_code WHEN 0 THEN 'OK' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'UNKNOWN' END AS status_text
  FROM status2)"""

BASE = [ENTITIES_SQL, HISTORY_SQL, *RULE_CTES]

UNRECOVERABLE_SQL = """last_full AS (
  SELECT entity_id, max(start_time) AS backup_time FROM history
  WHERE operation = 'B' AND operationtype IN ('F', 'N') GROUP BY entity_id),
unrec AS (
  SELECT h.*, f.backup_time FROM history h JOIN last_full f ON h.entity_id = f.entity_id
  WHERE h.operation = 'L' AND upper(h.cmd_text) LIKE '%NON-RECOVERABLE%' AND h.start_time > f.backup_time)"""

ISO = "strftime({t}, '%Y-%m-%d %H:%M:%S')"

STATUS_TEXT_SQL = "CASE {c} WHEN 0 THEN 'OK' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'UNKNOWN' END"


def _sql_register():
    from .registry import ORACLE
    full = with_sql(*BASE, RESOLVED_SQL)
    ORACLE["rules_parse"] = with_sql(*RULE_CTES) + "SELECT * FROM parsed_rules"
    ORACLE["rule_resolve"] = full + "SELECT entity_id, kind, line_no, warn_h, crit_h, dow FROM resolved"
    only_db = PARSED_RULES_SQL.replace("FROM rule_lines)", f"FROM rule_lines WHERE line_no > {OVERRIDE_LINE_BASE})")
    ORACLE["rule_defaults"] = with_sql(ENTITIES_SQL, THRESHOLD_LINES_SQL, only_db, RESOLVED_SQL) + \
        "SELECT entity_id, kind, line_no, warn_h, crit_h, dow FROM resolved"
    full_status_sql = with_sql(*BASE, RESOLVED_SQL, EXCL_SQL, UNRECOVERABLE_SQL, SCHEDULE_SQL, LATEST_SQL) + f"""
, bad AS (
  SELECT u.entity_id, u.kind, max('backup image of ' || {ISO.format(t='u.backup_time')} || ' has no value since a non-recoverable load into '
         || u.tabschema || '.' || u.tabname || ' on ' || {ISO.format(t='u.start_time')}) AS finding
  FROM (SELECT unrec.*, k.kind FROM unrec, (VALUES ('regular'), ('snapshot')) k(kind)) u
  LEFT JOIN exclusions x ON u.entity_id = x.entity_id AND u.kind = x.kind
  WHERE NOT coalesce(list_contains(string_split(x.excluded, ','), u.tabschema || '.' || u.tabname), false)
  GROUP BY u.entity_id, u.kind),
j AS (
  SELECT s.*, l.latest_time, b.finding, {AGE.format(t='l.latest_time')} AS age_hours
  FROM schedule s LEFT JOIN latest l ON s.entity_id = l.entity_id AND s.kind = l.kind
                  LEFT JOIN bad b ON s.entity_id = b.entity_id AND s.kind = b.kind
  WHERE s.schedule <> 'disabled'),
c AS (
  SELECT *, CAST(CASE WHEN schedule = 'not_today' THEN 0 WHEN finding IS NOT NULL THEN 2 WHEN age_hours IS NULL THEN 2
                 WHEN age_hours <= warn_h THEN 0 WHEN age_hours <= crit_h THEN 1 ELSE 2 END AS INTEGER) AS status_code FROM j),
checks AS (
SELECT entity_id, host, instance, dbname, kind, age_hours, warn_h, crit_h, status_code, CASE status_code WHEN 0 THEN 'OK' WHEN 1 THEN 'WARNING' ELSE 'CRITICAL' END AS status_text,
  CASE WHEN schedule = 'not_today' THEN 'off_day' WHEN finding IS NOT NULL THEN 'invalidated' WHEN age_hours IS NULL THEN 'never' ELSE 'age' END AS reason,
  CASE WHEN schedule = 'not_today' THEN 'No check configured for today for a ' || kind || ' backup'
       WHEN finding IS NOT NULL THEN kind || ' ' || finding WHEN age_hours IS NULL THEN kind || ' backup never taken'
       ELSE CAST(age_hours AS VARCHAR) || ' hours since last full backup at ' || {ISO.format(t='latest_time')} END AS message
FROM c)
"""
    ORACLE["freshness_full"] = full_status_sql + \
        "SELECT entity_id, kind, age_hours, warn_h, crit_h, status_code, status_text, reason, message FROM checks"
    ORACLE["exclusions_resolve"] = with_sql(*BASE, RESOLVED_SQL, EXCL_SQL) + "SELECT * FROM exclusions"
    ORACLE["dow_eligibility"] = full + f"""
SELECT h.event_id, h.entity_id, r.line_no, r.dow, CAST(isodow(CAST(h.start_time AS DATE)) AS INTEGER) AS day_of_week,
       {dow_matches_sql('r.dow', 'isodow(CAST(h.start_time AS DATE))')} AS eligible
FROM history h JOIN resolved r ON h.entity_id = r.entity_id AND r.kind = 'regular'
WHERE h.operation = 'B'"""
    ORACLE["latest_per_entity"] = with_sql(HISTORY_SQL, LATEST_SQL) + "SELECT * FROM latest"
    ORACLE["age_hours"] = with_sql(HISTORY_SQL, LATEST_SQL) + f"""
SELECT entity_id, kind, ts14, strftime(p, '%Y-%m-%d %H:%M:%S') AS iso, {AGE.format(t='p')} AS age_hours
FROM (SELECT *, strptime(ts14, '%Y%m%d%H%M%S') AS p FROM (
  SELECT entity_id, kind, strftime(latest_time, '%Y%m%d%H%M%S') AS ts14 FROM latest))"""
    ORACLE["events_after_latest"] = with_sql(HISTORY_SQL, UNRECOVERABLE_SQL) + """
SELECT entity_id, event_id, start_time, backup_time, tabschema || '.' || tabname AS table_name FROM unrec"""
    ORACLE["freshness_invalidated"] = with_sql(*BASE, RESOLVED_SQL, EXCL_SQL, UNRECOVERABLE_SQL) + f"""
SELECT entity_id, 2 AS status_code, 'CRITICAL' AS status_text, 'regular ' || max(msg) AS message FROM (
  SELECT u.entity_id, 'backup image of ' || {ISO.format(t='u.backup_time')} || ' has no value since a non-recoverable load into '
         || u.tabschema || '.' || u.tabname || ' on ' || {ISO.format(t='u.start_time')} AS msg
  FROM unrec u LEFT JOIN exclusions x ON u.entity_id = x.entity_id AND x.kind = 'regular'
  WHERE NOT coalesce(list_contains(string_split(x.excluded, ','), u.tabschema || '.' || u.tabname), false))
GROUP BY entity_id"""
    ORACLE["freshness_schedule"] = with_sql(*BASE, RESOLVED_SQL, SCHEDULE_SQL) + \
        "SELECT entity_id, kind, warn_h, crit_h, dow, eligible, schedule FROM schedule"
    status_full = with_sql(*BASE, RESOLVED_SQL, SCHEDULE_SQL, LATEST_SQL, STATUS_SQL)
    ORACLE["freshness_status"] = status_full + \
        "SELECT entity_id, kind, age_hours, warn_h, crit_h, status_code, status_text FROM status3"
    ORACLE["freshness_status_fixed"] = with_sql(ENTITIES_SQL, HISTORY_SQL) + f"""
SELECT entity_id, age_hours, status_code, {STATUS_TEXT_SQL.format(c='status_code')} AS status_text,
  CAST(status_code AS VARCHAR) || ' Age_last_backup_' || CAST(entity_id AS VARCHAR) || ' age_hours=' ||
  coalesce(CAST(age_hours AS VARCHAR), '0') || ';48;120;0; ' || {STATUS_TEXT_SQL.format(c='status_code')} || ' - ' ||
  coalesce(CAST(age_hours AS VARCHAR), '0') || ' hours since last ' || CAST(entity_id AS VARCHAR) || ' full backup' AS line FROM (
  SELECT e.entity_id, {AGE.format(t='b.latest_time')} AS age_hours,
         CASE WHEN b.latest_time IS NULL THEN 2 WHEN {AGE.format(t='b.latest_time')} < 100 THEN 0
              WHEN {AGE.format(t='b.latest_time')} < 200 THEN 1 ELSE 2 END AS status_code
  FROM entities e LEFT JOIN (SELECT entity_id, max(start_time) AS latest_time FROM history WHERE operation = 'B' GROUP BY 1) b
    ON e.entity_id = b.entity_id)"""
    ORACLE["status_lines"] = full_status_sql + f"""
SELECT entity_id, kind, status_code, reason,
  CAST(status_code AS VARCHAR) || ' ' ||
  concat_ws('_', 'Age_last_backup', kind, replace(host, ' ', ''), instance, dbname, CAST(entity_id AS VARCHAR)) || ' ' ||
  'age_hours=' || CASE WHEN reason = 'invalidated' THEN '0;{DEFAULT_WARN};{DEFAULT_CRIT};0;'
       ELSE CASE WHEN reason = 'off_day' THEN '' ELSE coalesce(CAST(age_hours AS VARCHAR), '0') || ';' END
            || CAST(warn_h AS VARCHAR) || ';' || CAST(crit_h AS VARCHAR) || ';0;' END || ' ' || status_text || ' - ' || message AS line
FROM checks"""
    ORACLE["overall_status"] = full_status_sql + """
SELECT host, count(*) AS n_checks, CAST(sum(status_code) AS BIGINT) AS sum_codes,
       CASE WHEN max(CASE WHEN status_code >= 2 THEN 1 ELSE 0 END) = 1 THEN 8
            WHEN max(CASE WHEN status_code = 1 THEN 1 ELSE 0 END) = 1 THEN 5 ELSE 0 END AS overall_code
FROM checks GROUP BY host"""

    avail_lines = f"avail_lines AS (SELECT * FROM (VALUES {_values_sql([(i + 1, s) for i, s in enumerate(AVAILABILITY_RULES)])}) t(line_no, line))"
    avail_rules = """avail_rules AS (
  SELECT line_no, lower(trim(split_part(t, ':', 1))) AS host, lower(trim(split_part(t, ':', 2))) AS instance,
         lower(trim(split_part(t, ':', 3))) AS dbname, lower(trim(split_part(t, ':', 4))) AS sensor,
         upper(CASE WHEN contains(v, ';') THEN trim(split_part(v, ';', 1)) ELSE '0' END) AS warn_state,
         upper(CASE WHEN contains(v, ';') THEN trim(split_part(v, ';', 2)) ELSE v END) AS crit_state
  FROM (SELECT line_no, t, trim(split_part(t, ':', 5)) AS v FROM
        (SELECT line_no, regexp_replace(line, '^[ \\t]+', '') AS t FROM avail_lines) WHERE t <> '' AND NOT starts_with(t, '#')))"""
    ent_keys = "ent_keys AS (" + lookup_keys_sql("e").replace("{src}", "entities") + ")"
    last_event = """last_event AS (SELECT user_id AS entity_id, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY 1)"""
    state_case = ("CASE le.last_event " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_OF_EVENT.items()) + " END")
    ORACLE["state_status"] = with_sql(ENTITIES_SQL, avail_lines, avail_rules, ent_keys, last_event) + f"""
, res AS (
  SELECT * FROM (
    SELECT k.entity_id, r.line_no, coalesce(r.warn_state, 'IMPLICIT') AS warn_state, coalesce(r.crit_state, 'INACTIVE') AS crit_state,
           row_number() OVER (PARTITION BY k.entity_id ORDER BY (r.line_no IS NULL)::INT, k.spec DESC, r.line_no DESC) rn
    FROM ent_keys k LEFT JOIN (SELECT * FROM avail_rules WHERE sensor = 'availability') r
      ON r.host = k.k_host AND r.instance = k.k_instance AND r.dbname = k.k_db) WHERE rn = 1),
j AS (
  SELECT r.entity_id, r.warn_state, r.crit_state, {state_case} AS state,
         CASE WHEN r.warn_state = 'EXPLICIT' THEN 'IMPLICIT' ELSE r.warn_state END AS w
  FROM res r LEFT JOIN last_event le ON r.entity_id = le.entity_id
  WHERE NOT (r.warn_state = '0' AND r.crit_state = '0')),
c AS (
  SELECT *, CASE WHEN state IS NULL THEN 3
                 WHEN state = 'INACTIVE' THEN CASE WHEN w = 'INACTIVE' THEN 1 ELSE 2 END
                 WHEN state = w THEN 1 WHEN state = crit_state THEN 2 WHEN state = 'UNKNOWN' THEN 1 ELSE 0 END AS status_code
  FROM j)
SELECT entity_id, warn_state, crit_state, state, status_code, {STATUS_TEXT_SQL.format(c='status_code')} AS status_text,
  CASE WHEN status_code = 0 THEN 'is active' WHEN status_code = 3 THEN 'is in an UNKNOWN state.'
       WHEN status_code = 1 AND state = 'UNKNOWN' AND w <> 'UNKNOWN' THEN 'is active, but cannot be determined if this is IMPLICIT or EXPLICIT.'
       WHEN status_code = 1 AND state = 'IMPLICIT' AND w = 'IMPLICIT' THEN 'should be activated EXPLICITLY.'
       WHEN status_code = 2 AND state = 'IMPLICIT' AND crit_state = 'IMPLICIT' THEN 'is not activated EXPLICITLY.'
       ELSE 'is INACTIVE.' END AS message
FROM c"""
    ORACLE["quiesce_status"] = with_sql(ENTITIES_SQL, last_event) + f"""
SELECT entity_id, status_code, {STATUS_TEXT_SQL.format(c='status_code')} AS status_text,
  CASE status_code WHEN 3 THEN 'is in an UNKNOWN state.' WHEN 2 THEN 'is QUIESCEd.'
       WHEN 1 THEN 'is QUIESCEd as part of a backup.' ELSE 'is not quiesced.' END AS message
FROM (SELECT e.entity_id,
        CASE WHEN le.last_event IS NULL OR le.last_event = 'error' THEN 3 WHEN le.last_event = 'view' THEN 2
             WHEN le.last_event = 'purchase' THEN 1 ELSE 0 END AS status_code
      FROM entities e LEFT JOIN last_event le ON e.entity_id = le.entity_id)"""
    both = ((ORACLE["state_status"], "Activation_status", "activation_status=", ";;2"), (ORACLE["quiesce_status"], "Quiesce_status", "quiesce_status=", ";1;2"))
    ORACLE["state_lines"] = " UNION ALL ".join(f"""
SELECT s.entity_id, '{service}' AS service, s.status_code, s.status_code || ' {service}_' || replace(i.host, ' ', '') || '_' || i.instance || '_' || i.dbname
       || ' {name}' || s.status_code || '{limits} ' || s.status_text || ' - ' || i.dbname || ' ' || s.message AS line
FROM ({sql}) s JOIN (SELECT * FROM ({with_sql(ENTITIES_SQL)} SELECT * FROM entities)) i USING (entity_id)""" for sql, service, name, limits in both)
    ORACLE["decision_table"] = with_sql(ENTITIES_SQL, last_event) + f"""
, d AS (
  SELECT e.entity_id,
         CASE WHEN e.acctbal < 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS requested,
         CASE WHEN e.dbname IN ('AUTOMOBILE', 'BUILDING') THEN 'ARCHIVE' WHEN e.dbname = 'FURNITURE' THEN 'LOGRETAIN' ELSE 'CIRCULAR' END AS log_method,
         coalesce({state_case}, 'INACTIVE') AS activation,
         e.acctbal > 9000 AS force,
         CASE WHEN le.last_event = 'purchase' THEN 'BACKUP' WHEN le.last_event = 'error' THEN 'LOAD' ELSE 'none' END AS utility
  FROM entities e LEFT JOIN last_event le ON e.entity_id = le.entity_id)
SELECT *,
  CASE WHEN log_method NOT IN ('ARCHIVE', 'LOGRETAIN') THEN 'OFFLINE' WHEN requested = 'OFFLINE' THEN 'OFFLINE'
       WHEN activation = 'INACTIVE' THEN 'OFFLINE' ELSE 'ONLINE' END AS chosen_mode,
  CASE WHEN upper(split_part(utility, ' ', 1)) IN ('BACKUP', 'RESTORE') THEN 11
       WHEN utility <> 'none' AND requested = 'OFFLINE' THEN 12
       WHEN requested = 'OFFLINE' AND NOT force AND activation <> 'INACTIVE' THEN 10 ELSE 0 END AS error_code
FROM d"""
    ret_lines = f"ret_lines AS (SELECT * FROM (VALUES {_values_sql([(i + 1, s) for i, s in enumerate(RETENTION_RULES)])}) t(line_no, line))"
    ret_rules = """ret_rules AS (
  SELECT line_no, lower(trim(split_part(line, ':', 1))) AS host, lower(trim(split_part(line, ':', 2))) AS instance,
         lower(trim(split_part(line, ':', 3))) AS dbname, TRY_CAST(trim(split_part(line, ':', 4)) AS INTEGER) AS copies,
         trim(split_part(line, ':', 5)) AS extra FROM ret_lines)"""
    ORACLE["retention_resolve"] = with_sql(ENTITIES_SQL, ret_lines, ret_rules, ent_keys) + """
, res AS (
  SELECT * FROM (
    SELECT k.entity_id, k.db_label, k.acctbal, r.line_no, r.copies, r.extra,
           row_number() OVER (PARTITION BY k.entity_id ORDER BY (r.line_no IS NULL)::INT, k.spec DESC, r.line_no DESC) rn
    FROM ent_keys k LEFT JOIN ret_rules r ON r.host = k.k_host AND r.instance = k.k_instance AND r.dbname = k.k_db)
  WHERE rn = 1),
x AS (
  SELECT *, ends_with(db_label, '77') OR starts_with(db_label, 'Customer#00000001') AS single,
         CASE WHEN copies > 0 THEN copies WHEN acctbal > 5000 THEN CAST(floor(acctbal / 1000) AS INTEGER) ELSE 1 END AS found
  FROM res)
SELECT entity_id, line_no, CASE WHEN single THEN 1 ELSE found END AS copies,
  CASE WHEN single THEN 1 WHEN extra IS NULL THEN found + 2 WHEN starts_with(extra, '+') THEN found + CAST(substr(extra, 2) AS INTEGER)
       ELSE CAST(extra AS INTEGER) END AS copies_db
FROM x"""


_sql_register()
