"""Identifier helpers: qualification, splitting, case folding, numeric test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qualify(schema: Column, name: Column) -> Column:
    """``TRIM(schema) || '.' || TRIM(name)``."""
    return F.concat_ws(".", F.trim(schema), F.trim(name))


def schema_of(qualified: Column, default_schema: Column | str) -> Column:
    """Schema part of ``S.N``; the default schema when unqualified."""
    default = F.lit(default_schema) if isinstance(default_schema, str) else default_schema
    return F.when(qualified.contains("."), F.split_part(qualified, F.lit("."), F.lit(1))).otherwise(default)


def name_of(qualified: Column) -> Column:
    return F.when(qualified.contains("."), F.split_part(qualified, F.lit("."), F.lit(2))).otherwise(qualified)


def fold_db(name: Column) -> Column:
    """Database names are upper case, blanks removed."""
    return F.upper(F.regexp_replace(name, r"\s+", ""))


def fold_instance(name: Column) -> Column:
    """Instance names are lower case, blanks removed."""
    return F.lower(F.regexp_replace(name, r"\s+", ""))


def is_numeric(text: Column) -> Column:
    """Unsigned digits only; NULL and empty text are not numeric."""
    return F.coalesce(text.rlike(r"^[0-9]+$"), F.lit(False))
