"""Log-analytics family: events and conversation turns rendered as diagnostic-log text, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as lg
from ..session import scratch_path
from ..sources.logs import read_log, render_record, write_log
from ..sources.tables import table
from .bindings import AS_OF_EVENTS_SQL, as_of_events, with_sql
from .registry import register

WINDOW_DAYS = 14
CONV_BASE = "2024-01-20 00:00:00"


def _records(spark, sf):
    ev, c, n = table(spark, sf, "events"), table(spark, sf, "customer"), table(spark, sf, "nation")
    et = F.col("event_type")
    level = (F.when(et == "error", F.when(F.col("value") >= 250, "Critical").otherwise("Error"))
             .when(et == "signup", "Severe").when(et == "view", "Warning").when(et == "click", "Event")
             .otherwise("Info"))
    e = (ev.join(c, ev.user_id == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
         .select(F.col("ts"), level.alias("level"), F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("rid"),
                 F.lower(F.regexp_replace("n_name", "_", "")).alias("instance"),
                 F.when(F.col("value") < 20, F.lit("")).otherwise(F.upper("c_mktsegment")).alias("db"),
                 F.concat_ws(" ", F.lit("event"), F.col("event_id").cast("string"), et, F.col("props")).alias("message")))
    cv = table(spark, sf, "conversations")
    ts = (F.lit(CONV_BASE).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("conv_id").cast("int"))
          + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("turn").cast("int")))
    role = F.col("role")
    cr = cv.select(ts.alias("ts"), F.concat(F.upper(F.substring(role, 1, 1)), F.substr(role, F.lit(2))).alias("level"),
                   F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("rid"),
                   F.lit("conv").alias("instance"), F.lit("").alias("db"),
                   F.regexp_replace("text", r"\s+", " ").alias("message"))
    return e.unionByName(cr)


def parsed_window(spark, sf):
    """The log rendered into day folders and read back; the window prunes the folders, then the records."""
    recs = _records(spark, sf).select(
        F.to_date("ts").alias("day"),
        render_record(F.col("ts"), F.col("level"), F.col("rid"), F.col("instance"), F.col("db"), F.col("message")).alias("record"))
    path = write_log(recs, scratch_path(spark, "diaglog"), day_col="day")
    first = F.to_date(as_of_events() - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS"))
    log = read_log(spark, path, day_col="day").where((F.col("day") >= first) & (F.col("day") <= F.to_date(as_of_events()))).drop("day")
    return lg.last_days(log, "ts", as_of_events(), WINDOW_DAYS)


RECORDS_SQL = f"""recs AS (
  SELECT e.ts,
    CASE WHEN e.event_type = 'error' THEN CASE WHEN e.value >= 250 THEN 'Critical' ELSE 'Error' END
         WHEN e.event_type = 'signup' THEN 'Severe' WHEN e.event_type = 'view' THEN 'Warning'
         WHEN e.event_type = 'click' THEN 'Event' ELSE 'Info' END AS level,
    'E' || CAST(e.event_id AS VARCHAR) AS rid, lower(replace(n.n_name, '_', '')) AS instance,
    CASE WHEN e.value < 20 THEN '' ELSE upper(c.c_mktsegment) END AS db,
    concat_ws(' ', 'event', CAST(e.event_id AS VARCHAR), e.event_type, e.props) AS message
  FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  UNION ALL
  SELECT TIMESTAMP '{CONV_BASE}' + to_minutes(conv_id) + to_seconds(turn),
    upper(substr(role, 1, 1)) || substr(role, 2), 'C' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR),
    'conv', '', regexp_replace(text, '\\s+', ' ', 'g')
  FROM conversations),
win AS (SELECT * FROM recs WHERE ts >= {AS_OF_EVENTS_SQL} - INTERVAL {WINDOW_DAYS} DAYS AND ts <= {AS_OF_EVENTS_SQL})"""
KNOWN_SQL = "(" + ", ".join(f"'{x}'" for x in lg.KNOWN_LEVELS) + ")"
DOMAIN_SQL = "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(lg.REPORTED_LEVELS)) + ") d(ord, level)"
SECTIONS_SQL = " UNION ALL ".join(
    f"SELECT '{title}' AS section, instance, db, count(*) AS n FROM win WHERE level = '{lv}' AND instance <> '' GROUP BY instance, db"
    for lv, title in lg.SECTION_LEVELS)


@register("log_parse", with_sql(RECORDS_SQL) + "SELECT rid, ts, level, instance, db, message FROM win")
def q_log_parse(spark, sf):
    return parsed_window(spark, sf)


@register("log_severity_counts", with_sql(RECORDS_SQL) + f"""
SELECT d.ord, d.level, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM {DOMAIN_SQL}
LEFT JOIN (SELECT level, count(*) AS n FROM win GROUP BY level) c ON c.level = d.level""")
def q_log_severity_counts(spark, sf):
    return lg.severity_counts(spark, parsed_window(spark, sf))


@register("log_unknown_levels", with_sql(RECORDS_SQL) + f"SELECT DISTINCT level FROM win WHERE level <> '' AND level NOT IN {KNOWN_SQL}")
def q_log_unknown_levels(spark, sf):
    return lg.unknown_levels(parsed_window(spark, sf))


@register("log_time_range", with_sql(RECORDS_SQL) + "SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_records FROM win")
def q_log_time_range(spark, sf):
    return lg.time_range(parsed_window(spark, sf))


@register("log_sections", with_sql(RECORDS_SQL) + SECTIONS_SQL)
def q_log_sections(spark, sf):
    return lg.sections(parsed_window(spark, sf))


ARCHIVE_NAME = "diaglog.archive"


def _report_sql():
    parts = [
        "SELECT * FROM (VALUES (0, '', '0', ''), (0, '', '1', '  Diagnostics Log Report'), (0, '', '2', '  ======================'), "
        f"(0, '', '3', ''), (0, '', '4', '    Current log archived to {ARCHIVE_NAME}'), (0, '', '5', '')) t(section_no, grp, seq, line)",
        "SELECT 1, '', '0', coalesce('    First message :- ' || strftime(min(ts), '%Y-%m-%d-%H.%M.%S.%f'), '') FROM win",
        "SELECT 1, '', '1', coalesce('    Last message  :- ' || strftime(max(ts), '%Y-%m-%d-%H.%M.%S.%f'), '') FROM win",
        f"SELECT DISTINCT 2, level, '0', 'Unknown error level of ' || level || ' found' FROM win WHERE level <> '' AND level NOT IN {KNOWN_SQL}",
        f"SELECT 3, '', CAST(d.ord AS VARCHAR), lpad(d.level, 15, ' ') || ': ' || CAST(coalesce(c.n, 0) AS VARCHAR) FROM {DOMAIN_SQL} "
        "LEFT JOIN (SELECT level, count(*) AS n FROM win GROUP BY level) c ON c.level = d.level",
    ]
    gate = f"(SELECT count(*) FROM win WHERE level IN ({', '.join(repr(x) for x in lg.REPORTED_LEVELS)})) > 0"
    for i, (lv, title) in enumerate(lg.SECTION_LEVELS):
        no = 4 + i
        grp = "concat_ws('$', instance, db)"
        parts.append(f"SELECT {no}, '', '0', '  {title} ' WHERE {gate}")
        parts.append(f"SELECT {no}, '', '1', '  {'-' * (len(title) + 1)}' WHERE {gate}")
        parts.append(f"SELECT DISTINCT {no}, {grp}, '0', CASE WHEN db <> '' THEN '  ##  Instance: ' || instance || ' Database: ' || db || ' ' "
                     f"ELSE '  ##  Instance: ' || instance || ' ' END FROM win WHERE level = '{lv}' AND instance <> '' AND {gate}")
        parts.append(f"SELECT {no}, {grp}, '1' || strftime(ts, '%Y%m%d%H%M%S%f') || '-' || rid, "
                     f"'    ' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || rid || ' ' || message FROM win "
                     f"WHERE level = '{lv}' AND instance <> '' AND {gate}")
    parts.append("SELECT * FROM (VALUES (9, '', '0', ''), (9, '', '1', 'End of Report')) e(section_no, grp, seq, line)")
    return with_sql(RECORDS_SQL) + "\nUNION ALL\n".join(parts)


@register("log_report", _report_sql())
def q_log_report(spark, sf):
    return lg.report(spark, parsed_window(spark, sf), ARCHIVE_NAME)
