"""Maintenance in ordered phases with a journal, so a rerun takes up where work failed or the driver was lost.

A plan has a row per table and phase, and a row per schema for the phases that come once all its tables are through. A phase
takes the tables whose earlier phases are done and that are not done themselves; what its action says of each is appended to the
journal. Tables that fail stay behind, the others go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from ..sources.files import optional_source
from .lineage import durable

JOURNAL = StructType([StructField("schema", StringType()), StructField("tab", StringType()), StructField("step", IntegerType()), StructField("phase", StringType()),
                      StructField("ok", BooleanType()), StructField("n", LongType()), StructField("at", TimestampType())])


def plan(tables: DataFrame, table_phases: list[str], schema_phases: list[str]) -> DataFrame:
    """(schema, tab, step, phase) of tables (schema, tab); a phase may come more than once. Schema phases have no tab."""
    def steps(names: list[str], first: int):
        return F.explode(F.array(*[F.struct(F.lit(first + i).alias("step"), F.lit(p).alias("phase")) for i, p in enumerate(names)])).alias("p")

    out = tables.select("schema", "tab", steps(table_phases, 0)).select("schema", "tab", "p.*")
    if schema_phases:
        per_schema = tables.select("schema").distinct().select("schema", F.lit(None).cast("string").alias("tab"), steps(schema_phases, len(table_phases)))
        out = out.unionByName(per_schema.select("schema", "tab", "p.*"))
    return out


def done(journal: DataFrame) -> DataFrame:
    return journal.where("ok").select("schema", "tab", "step").distinct()


def ready(work: DataFrame, journal: DataFrame, step: int) -> DataFrame:
    """Rows of one step that are not done and that no open row of an earlier step holds back: a table waits for itself,
    a schema for all its tables."""
    finished = done(journal).select("schema", F.col("tab").alias("_tab"), F.col("step").alias("_step"))
    is_done = (work["schema"] == finished["schema"]) & work["tab"].eqNullSafe(finished["_tab"]) & (work["step"] == finished["_step"])
    open_ = work.join(finished, is_done, "left_anti")
    now = open_.where(F.col("step") == step)
    before = open_.where(F.col("step") < step).select(F.col("schema").alias("_schema"), F.col("tab").alias("_of")).distinct()
    held = (F.col("schema") == F.col("_schema")) & (F.col("tab").isNull() | F.col("tab").eqNullSafe(F.col("_of")))
    return now.join(before, held, "left_anti")


def run_plan(spark: SparkSession, path: str, work: DataFrame, actions: dict[str, Callable[[DataFrame], DataFrame]]) -> int:
    """Runs every step once over what is ready; how many rows are still open. An action gets rows (schema, tab) and returns
    (schema, tab, ok, n); a row that it says nothing of stays open."""
    work = durable(work)
    for r in work.select("step", "phase").distinct().orderBy("step").collect():  # the steps of the plan
        todo = durable(ready(work, optional_source(spark, path, JOURNAL), r.step).select("schema", "tab"))
        if todo.isEmpty():
            continue
        said = actions[r.phase](todo)
        said.select("schema", "tab", F.lit(r.step).alias("step"), F.lit(r.phase).alias("phase"), F.col("ok").cast("boolean").alias("ok"),
                    F.col("n").cast("long").alias("n"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)
    return work.count() - done(optional_source(spark, path, JOURNAL)).count()
