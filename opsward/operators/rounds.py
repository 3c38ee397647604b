"""Integrity rounds: pending tables are validated round by round until none is left, from a stored state.

All tables are in long form, so a round is one set of Spark jobs however many tables there are: ``rows`` (tab, id, ok), where ok
tells whether the row passes its own checks, and ``refs`` (tab, id, parent, parent_id), a row for each foreign key
value that is not NULL. ``tables`` (tab, pending) and ``fks`` (child, parent) are the catalog.

A round takes the first ``per_round`` pending tables by name (code SQL3600N) and adds their pending parents (SQL3608N, action
add_parent). A table checked for the first time is read whole; one that is pending because parent rows were
diverted is only asked for references to rows that are exceptions by now. Violating rows go to the exceptions (SQL3603N, action
divert_rows) and their table's children become pending again. Rounds end when nothing is pending: each one
diverts a row or clears a table, so cycles end too.

State and exceptions of round n are written to ``<path>/round=<n>``, the state last: a driver that dies loses the round it is in,
and the next call goes on after the last complete one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import optional_source
from .lineage import durable

STATE = "tab string, pending boolean, checked boolean, code string, action string, diverted long"
EXCEPTIONS = "tab string, id long, reason string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def last_round(spark: SparkSession, path: str) -> int:
    """Number of the last complete round; -1 if there is none."""
    n = -1
    while _exists(spark, f"{path}/round={n + 1}/state/_SUCCESS"):
        n += 1
    return n


def exceptions_of(spark: SparkSession, path: str, rounds: int) -> DataFrame:
    """Exception rows of the rounds up to number ``rounds`` (exclusive)."""
    out = spark.createDataFrame([], EXCEPTIONS)
    for n in range(rounds):
        out = out.unionByName(optional_source(spark, f"{path}/round={n}/exceptions", out.schema))
    return out


def _with_parents(listed: DataFrame, pending: DataFrame, fks: DataFrame) -> DataFrame:
    """The listed tables and, through all levels, their pending parents: (tab, added)."""
    batch = listed.select("tab", F.lit(False).alias("added"))
    edges = fks.join(pending.select(F.col("tab").alias("parent")), "parent", "left_semi")
    while True:
        more = (edges.join(batch.select(F.col("tab").alias("child")), "child", "left_semi").select(F.col("parent").alias("tab")).distinct()
                .join(batch, "tab", "left_anti").withColumn("added", F.lit(True)))
        more = durable(more)
        if more.isEmpty():
            return batch
        batch = durable(batch.unionByName(more))


def _violations(batch: DataFrame, rows: DataFrame, refs: DataFrame, gone: DataFrame, parents: DataFrame) -> DataFrame:
    """(tab, id, reason) of rows of the batch that are no exceptions yet and fail now. ``parents``: the tables that references name;
    only their rows can be missed."""
    fk = F.lit("FK").alias("reason")
    lost = gone.join(parents, "tab", "left_semi").select(F.col("tab").alias("parent"), F.col("id").alias("parent_id")).distinct()
    found = refs.join(F.broadcast(batch.select("tab")), "tab", "left_semi").join(lost, ["parent", "parent_id"], "left_semi").select("tab", "id", fk)
    first = batch.where(~F.col("checked")).select("tab")
    if not first.isEmpty():  # else no table is read whole
        first = F.broadcast(first)
        own = rows.join(first, "tab", "left_semi").where(~F.coalesce("ok", F.lit(True))).select("tab", "id", F.lit("CHECK").alias("reason"))
        present = rows.join(F.broadcast(parents), "tab", "left_semi").select(F.col("tab").alias("parent"), F.col("id").alias("parent_id"))
        absent = refs.join(first, "tab", "left_semi").join(present, ["parent", "parent_id"], "left_anti").select("tab", "id", fk)
        found = found.unionByName(own).unionByName(absent)
    # a check of the row itself comes before its references
    return found.groupBy("tab", "id").agg(F.min("reason").alias("reason")).join(gone, ["tab", "id"], "left_anti")


def step(spark: SparkSession, path: str, n: int, state: DataFrame, fks: DataFrame, rows: DataFrame, refs: DataFrame, parents: DataFrame, per_round: int) -> bool:
    """Round n; False if nothing was pending."""
    pending = state.where("pending").select("tab")
    listed = durable(pending.orderBy("tab").limit(per_round))  # the feature: so many tables in a round
    if listed.isEmpty():
        return False
    batch = durable(_with_parents(listed, pending, fks).join(state.select("tab", "checked"), "tab"))
    gone = exceptions_of(spark, path, n)
    _violations(batch, rows, refs, gone, parents).write.mode("overwrite").parquet(f"{path}/round={n}/exceptions")
    counts = spark.read.schema(EXCEPTIONS).parquet(f"{path}/round={n}/exceptions").groupBy("tab").agg(F.count(F.lit(1)).alias("diverted"))
    counts = durable(counts)
    reopened = fks.join(counts.select(F.col("tab").alias("parent")), "parent", "left_semi").select(F.col("child").alias("tab")).distinct().withColumn("reopened", F.lit(True))
    now = (state.select("tab", F.col("pending").alias("was"), F.col("checked").alias("before"), F.col("code").alias("c"), F.col("action").alias("a"))
           .join(batch.select("tab", "added"), "tab", "left").join(counts, "tab", "left").join(reopened, "tab", "left"))
    taken, bad = F.col("added").isNotNull(), F.col("diverted").isNotNull()
    code = F.when(bad, "SQL3603N").when(F.col("added"), "SQL3608N").when(taken, "SQL3600N").otherwise(F.col("c"))
    action = F.when(bad, "divert_rows").when(F.col("added"), "add_parent").when(taken, "check").otherwise(F.col("a"))
    now.select("tab", (F.coalesce("reopened", F.lit(False)) | (F.col("was") & ~taken)).alias("pending"), (F.col("before") | taken).alias("checked"),
               code.alias("code"), action.alias("action"), F.coalesce("diverted", F.lit(0)).cast("long").alias("diverted")
               ).write.mode("overwrite").parquet(f"{path}/round={n}/state")
    return True


def resolve_pending(spark: SparkSession, path: str, tables: DataFrame, fks: DataFrame, rows: DataFrame, refs: DataFrame,
                    per_round: int = 50, most_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs rounds until nothing is pending, or at most ``most_rounds`` of them in this call: (state, exceptions)."""
    done = last_round(spark, path)
    start = tables.select("tab", "pending", F.lit(False).alias("checked"), F.lit("").alias("code"), F.lit("").alias("action"), F.lit(0).cast("long").alias("diverted"))
    fks, parents = durable(fks.distinct()), durable(refs.select(F.col("parent").alias("tab")).distinct())
    ran = 0
    while most_rounds is None or ran < most_rounds:
        state = spark.read.schema(STATE).parquet(f"{path}/round={done}/state") if done >= 0 else start
        if not step(spark, path, done + 1, state, fks, rows, refs, parents, per_round):
            break
        done, ran = done + 1, ran + 1
    state = spark.read.schema(STATE).parquet(f"{path}/round={done}/state") if done >= 0 else start
    return state, exceptions_of(spark, path, done + 1)
