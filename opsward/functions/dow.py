"""Day-of-week eligibility of a rule: ``*``, ``1``, ``1-5``, ``1,3,5``, ``1-5,7`` (Monday = 1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_dow(day: Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(day) + 1


def dow_matches(spec: Column, dow: Column) -> Column:
    """True when ``dow`` is inside one of the comma-separated items or ranges.

    A list without a range disables the check on other days — the documented
    meaning of the rule file, not the shell's fall-through.
    """
    items = F.split(F.regexp_replace(spec, r"\s+", ""), ",")

    def item_hits(x: Column) -> Column:
        lo = F.split_part(x, F.lit("-"), F.lit(1)).try_cast("int")
        hi = F.split_part(x, F.lit("-"), F.lit(2)).try_cast("int")
        return F.when(x.contains("-"), (dow >= lo) & (dow <= hi)).otherwise(x.try_cast("int") == dow)

    return (F.trim(spec) == "*") | F.coalesce(F.exists(items, item_hits), F.lit(False))
