"""Latest-event operators: per-entity maxima that stay skew-safe.

``groupBy().agg(max_by)`` combines map-side, so an entity holding a third of
the history still ships one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_entity(df: DataFrame, entity_cols: list[str], ts_col: str, tiebreak: str,
                      carry: list[str] | None = None) -> DataFrame:
    carry = carry or []
    best = F.max(F.struct(F.col(ts_col).alias("_t"), F.col(tiebreak).alias("_id"), *[F.col(c) for c in carry]))
    out = df.groupBy(*entity_cols).agg(best.alias("b"))
    return out.select(*entity_cols, F.col("b._t").alias(ts_col), F.col("b._id").alias(tiebreak),
                      *[F.col(f"b.{c}").alias(c) for c in carry])


def latest_with_ties(df: DataFrame, group_cols: list[str], version_col: str) -> DataFrame:
    """All rows carrying the group's maximum version (ties survive): aggregate + join back."""
    top = df.groupBy(*group_cols).agg(F.max(version_col).alias("_max_v"))
    return (df.join(top, group_cols, "inner")
              .where(F.col(version_col) == F.col("_max_v")).drop("_max_v"))


def events_after(events: DataFrame, marks: DataFrame, entity_cols: list[str], ts_col: str, mark_col: str) -> DataFrame:
    """Events strictly after the entity's mark: equi-join on the entity + inequality."""
    return events.join(marks, entity_cols, "inner").where(F.col(ts_col) > F.col(mark_col))


def first_finding(df: DataFrame, group_cols: list[str], text: Column, alias: str = "finding") -> DataFrame:
    """``ORDER BY text DESC ... head -1`` per group as a plain aggregate."""
    return df.groupBy(*group_cols).agg(F.max(text).alias(alias))
