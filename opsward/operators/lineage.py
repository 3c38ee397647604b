"""Cutting lineage durably: a reliable checkpoint in the shared ``spark.checkpoint.dir``.

A reliable checkpoint re-runs the plan when it writes the files unless the data
is persisted first, so persist -> checkpoint -> unpersist.  Never a
local checkpoint: executor loss must not lose the data.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
