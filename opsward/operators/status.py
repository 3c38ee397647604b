"""Status, SLA and state evaluation as ordered CASE expressions over joined facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS_TEXT = {0: "OK", 1: "WARNING", 2: "CRITICAL", 3: "UNKNOWN"}


def status_text(code: Column) -> Column:
    expr = None
    for k, v in STATUS_TEXT.items():
        expr = (F.when(code == k, F.lit(v)) if expr is None else expr.when(code == k, F.lit(v)))
    return expr.otherwise(F.lit(None))


def freshness_code(age_h: Column, warn_h: Column, crit_h: Column) -> Column:
    """age <= warn -> 0; age <= crit -> 1; else (or never) -> 2."""
    return (F.when(age_h.isNull(), F.lit(2))
            .when(age_h <= warn_h, F.lit(0))
            .when(age_h <= crit_h, F.lit(1))
            .otherwise(F.lit(2)))


def fixed_freshness_code(age_h: Column, warn_below: int = 100, crit_from: int = 200) -> Column:
    """The simple check: < 100 OK, < 200 WARNING, else CRITICAL (never -> CRITICAL)."""
    return (F.when(age_h.isNull(), F.lit(2))
            .when(age_h < warn_below, F.lit(0))
            .when(age_h < crit_from, F.lit(1))
            .otherwise(F.lit(2)))


def schedule_state(crit_h: Column, eligible_today: Column) -> Column:
    """'disabled' (threshold 0), 'not_today' (day-of-week says no), else 'active'."""
    return (F.when(crit_h.isNull() | (crit_h == 0), F.lit("disabled"))
            .when(~eligible_today, F.lit("not_today"))
            .otherwise(F.lit("active")))


def activation_code(state: Column, warn: Column, crit: Column) -> Column:
    """Activation state vs configured warn/crit states.

    No state information -> 3.  Not activated -> 2 unless the warning state is
    INACTIVE (-> 1).  Active: equal to warn -> 1, equal to crit -> 2, UNKNOWN
    -> 1, otherwise 0.  A warning state EXPLICIT is demoted to IMPLICIT first.
    """
    w = F.when(warn == "EXPLICIT", F.lit("IMPLICIT")).otherwise(warn)
    return (F.when(state.isNull(), F.lit(3))
            .when(state == "INACTIVE", F.when(w == "INACTIVE", F.lit(1)).otherwise(F.lit(2)))
            .when(state == w, F.lit(1))
            .when(state == crit, F.lit(2))
            .when(state == "UNKNOWN", F.lit(1))
            .otherwise(F.lit(0)))


def activation_text(state: Column, warn: Column, crit: Column, code: Column) -> Column:
    w = F.when(warn == "EXPLICIT", F.lit("IMPLICIT")).otherwise(warn)
    return (F.when(code == 0, F.lit("is active"))
            .when(code == 3, F.lit("is in an UNKNOWN state."))
            .when((code == 1) & (state == "UNKNOWN") & (w != "UNKNOWN"),
                  F.lit("is active, but cannot be determined if this is IMPLICIT or EXPLICIT."))
            .when((code == 1) & (state == "IMPLICIT") & (w == "IMPLICIT"), F.lit("should be activated EXPLICITLY."))
            .when((code == 2) & (state == "IMPLICIT") & (crit == "IMPLICIT"), F.lit("is not activated EXPLICITLY."))
            .otherwise(F.lit("is INACTIVE.")))


def quiesce_code(activated: Column, quiesced: Column, backup_running: Column) -> Column:
    """Not activated / no info -> 3; quiesced -> 2; not quiesced -> 0, or 1 while a backup runs."""
    return (F.when(activated.isNull() | ~activated, F.lit(3))
            .when(quiesced, F.lit(2))
            .when(backup_running, F.lit(1))
            .otherwise(F.lit(0)))


def quiesce_text(code: Column) -> Column:
    return (F.when(code == 3, F.lit("is in an UNKNOWN state."))
            .when(code == 2, F.lit("is QUIESCEd."))
            .when(code == 1, F.lit("is QUIESCEd as part of a backup."))
            .otherwise(F.lit("is not quiesced.")))


def backup_decision(requested: Column, log_method: Column, activation: Column, force: Column,
                    utility: Column) -> tuple[Column, Column]:
    """(chosen mode, error code): recoverable logging -> ONLINE unless inactive or
    OFFLINE asked; circular logging -> OFFLINE.  Errors: a backup/restore running
    -> 11; another utility during OFFLINE -> 12; OFFLINE on an active database
    without force -> 10."""
    recoverable = log_method.isin("ARCHIVE", "LOGRETAIN")
    chosen = (F.when(~recoverable, F.lit("OFFLINE"))
              .when(requested == "OFFLINE", F.lit("OFFLINE"))
              .when(activation == "INACTIVE", F.lit("OFFLINE"))
              .otherwise(F.lit("ONLINE")))
    running = F.upper(F.split_part(utility, F.lit(" "), F.lit(1)))
    err = (F.when(running.isin("BACKUP", "RESTORE"), F.lit(11))
           .when((utility != "none") & (requested == "OFFLINE"), F.lit(12))
           .when((requested == "OFFLINE") & ~force & (activation != "INACTIVE"), F.lit(10))
           .otherwise(F.lit(0)))
    return chosen, err


def status_line(code: Column, service: Column, perf: Column, message: Column) -> Column:
    """``code service perfdata TEXT - message`` (monitoring-agent local check format)."""
    return F.concat_ws(" ", code.cast("string"), service, perf, F.concat_ws(" - ", status_text(code), message))


def overall(df: DataFrame, group_cols: list[str], code_col: str = "status_code") -> DataFrame:
    """Sum of codes, and the worst-of code: 8 any error, 5 any warning, else 0."""
    c = F.col(code_col)
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.sum(c).cast("long").alias("sum_codes"),
        F.when(F.max(F.when(c >= 2, 1).otherwise(0)) == 1, F.lit(8))
         .when(F.max(F.when(c == 1, 1).otherwise(0)) == 1, F.lit(5))
         .otherwise(F.lit(0)).alias("overall_code"),
    )
