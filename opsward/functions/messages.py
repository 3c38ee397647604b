"""Message-code classification for utility output (``SQLnnnnX`` lines)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
# completion messages that never count as an error of an import,
# and the message-code -> next-action table of the integrity resolver.
IGNORED_CODES = ["SQL3109N", "SQL3110N", "SQL3149N", "SQL3150N", "SQL3153N"]
ACTIONS = {
    "SQL3600N": "done",
    "SQL3608N": "add_parent",
    "SQL0104N": "abort",
    "SQL3603N": "divert",
    "SQL0101N": "abort",
    "SQL0668N": "abort",
    "SQL0290N": "abort",
    "SQL0204N": "resolve_truncated_name",
    "SQL0171N": "abort",
    "SQL1224N": "abort",
    "SQL1024N": "abort",
}
DEFAULT_ACTION = "unknown"
NO_CODE_ACTION = "done"

_IGNORED_RE = "^(" + "|".join(IGNORED_CODES) + ")"


def first_code(text: Column) -> Column:
    """First ``SQLnnnnX`` code at the start of a line, '' when none."""
    return F.regexp_extract(text, r"(?m)^(SQL[0-9]+[NWC])", 1)


def first_error_code(text: Column) -> Column:
    """First ``SQLnnnnN`` (error) code at the start of a line, '' when none."""
    return F.regexp_extract(text, r"(?m)^(SQL[0-9]+N)", 1)


def severity(code: Column) -> Column:
    return (
        F.when(code == "", F.lit("none"))
        .when(code.rlike(_IGNORED_RE), F.lit("ignored"))
        .when(code.endswith("N"), F.lit("error"))
        .when(code.endswith("W"), F.lit("warning"))
        .otherwise(F.lit("critical"))
    )


def escalated_rc(text: Column, rc: Column) -> Column:
    """A zero return code becomes 8 when a non-ignored ``SQL3[2-9]..N`` line is present."""
    bad = F.regexp_replace(text, r"(?m)^SQL31(09|10|49|50|53)N.*$", "").rlike(r"(?m)^SQL3[2-9][0-9]*N")
    return F.when((rc == 0) & bad, F.lit(8)).otherwise(rc)


def error_detail(text: Column) -> Column:
    """Tail of the output from the first decisive line on (first rule that matches wins)."""
    t1 = F.regexp_extract(text, r"(?ms)^(SQL3109N.*)", 1)
    t2 = F.regexp_extract(F.regexp_replace(text, r"(?m)^SQL31(09|10|49|50|53)N.*(\n|$)", ""), r"(?ms)^(SQL3[2-9][0-9]*N.*)", 1)
    t3 = F.regexp_extract(text, r"(?ms)^(SQL0104N.*)", 1)
    return F.when(t1 != "", t1).when(t2 != "", t2).when(t3 != "", t3).otherwise(F.lit(""))


def action_for(code: Column) -> Column:
    expr = F.when(code == "", F.lit(NO_CODE_ACTION))
    for c, a in ACTIONS.items():
        expr = expr.when(code == c, F.lit(a))
    return expr.otherwise(F.lit(DEFAULT_ACTION))
