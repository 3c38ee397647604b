"""Keyed upsert and touch-last-seen merge on plain files (no MERGE needed).

* duplicates inside a batch: the highest load sequence wins, via a map-side
  combinable ``max_by`` (a hot key ships one partial row per map task);
* keys may be NULL: matching is NULL-safe (``eqNullSafe``), still a hash join;
* writing back: only partitions touched by the batch are read and rewritten (dynamic
  partition overwrite; the null partition counts as one); the merged result is checkpointed to
  the shared checkpoint folder first so the overwrite never reads its own output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.files import clustered, optional_source
from .lineage import durable


def dedupe_latest(df: DataFrame, keys: list[str], seq_col: str) -> DataFrame:
    """One row per key: the row with the highest ``seq_col``."""
    cols = df.columns
    # a row without a sequence ranks lowest but stays a row: max_by skips null orderings, a struct is never null
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(seq_col).isNotNull(), F.col(seq_col)))
    return df.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(best.alias("_r")).select("_r.*")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], seq_col: str | None = None,
           guard: str = "source_wins") -> DataFrame:
    """INSERT_UPDATE: source rows replace target rows with equal keys, new keys are inserted.

    ``guard='newest'`` keeps, per key, whichever of target/source has the
    higher ``seq_col`` (late or replayed batches never move a key backwards).
    """
    src = dedupe_latest(source, keys, seq_col) if seq_col else source
    if guard == "newest":
        if not seq_col:
            raise ValueError("guard='newest' needs seq_col")
        return dedupe_latest(target.unionByName(src), keys, seq_col)
    sk = src.select(*[F.col(k).alias(f"_s_{k}") for k in keys])
    kept = target.join(sk, _null_safe(target, sk, keys, "_s_"), "left_anti")
    return kept.unionByName(src)


def merge_last_seen(target: DataFrame, source: DataFrame, keys: list[str], ts_col: str) -> DataFrame:
    """Match -> only the timestamp moves to the source's latest; no match -> insert."""
    src = dedupe_latest(source, keys, ts_col)
    s = src.select(*[F.col(c).alias(f"_s_{c}") for c in src.columns], F.lit(True).alias("_s"))
    t = target.withColumn("_t", F.lit(True))
    j = t.join(s, _null_safe(t, s, keys, "_s_"), "full_outer")
    out = []
    for c in target.columns:
        new = F.col(f"_s_{c}") if c in src.columns else F.lit(None).cast(target.schema[c].dataType)
        if c == ts_col:
            out.append(F.coalesce(new, t[c]).alias(c))
        else:  # a matched row keeps all else, nulls too; an inserted one is the source's
            out.append(F.when(F.col("_t"), t[c]).otherwise(new).alias(c))
    return j.select(*out)


def touched_rows(existing: DataFrame, source: DataFrame, partition_cols: list[str]) -> DataFrame:
    """The rows of the partitions that ``source`` touches, the null partition included."""
    if not partition_cols:
        return existing
    touched = source.select(*[F.col(c).alias(f"_p_{c}") for c in partition_cols]).distinct()
    return existing.join(touched, _null_safe(existing, touched, partition_cols, "_p_"), "left_semi")


def write_partitions(rows: DataFrame, path: str, partition_cols: list[str], fmt: str = "parquet", mark: str | None = None) -> dict:
    """Replaces the partitions that ``rows`` holds; the counters are observed on the write itself."""
    obs = Observation("partitions_written")
    counts = [F.count(F.lit(1)).alias("rows_written")]
    if mark:
        counts.append(F.count(F.when(F.col(mark), 1)).alias("rows_from_batch"))
    out = clustered(rows, partition_cols).observe(obs, *counts)
    out = out.drop(mark) if mark else out
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).format(fmt).save(path))
    return dict(obs.get)


def load_order() -> Column:
    """Where a row stands in its batch: file, split and row."""
    return F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id())


def upsert_into_path(spark: SparkSession, path: str, source: DataFrame, keys: list[str], seq_col: str | None,
                     partition_cols: list[str], guard: str = "source_wins", fmt: str = "parquet") -> dict:
    """Apply a batch to a partitioned table on shared storage.

    The partition columns must follow from the key (or be part of it): a key that could move to another partition
    would leave its old row behind, as only touched partitions are read. Without a ``seq_col`` the last row of a key wins, by
    file name, place in the file and row for a batch that is read from files (however Spark packs them into tasks), else
    by the order of the batch's rows. The batch is evaluated once (deduplicated and
    stored) and then serves both the choice of partitions and the merge. Returns the row counters of the load,
    gathered with ``DataFrame.observe`` on the write itself.
    """
    order = seq_col or "_order"
    batch = source if seq_col else source.withColumn(order, load_order())
    batch = durable(dedupe_latest(batch, keys, order))
    if not seq_col:
        batch = batch.drop(order)
    existing = optional_source(spark, path, source.schema, fmt)
    target = touched_rows(existing, batch, partition_cols)
    mark = "_from_batch"
    merged = durable(upsert(target.withColumn(mark, F.lit(False)), batch.withColumn(mark, F.lit(True)),
                            keys, seq_col, guard=guard))
    return write_partitions(merged, path, partition_cols, fmt, mark)
