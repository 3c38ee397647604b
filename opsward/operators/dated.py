"""Event tables partitioned by date although the date is no part of the key.

A compact index holds the digest of each key and the dates it was ever written to. A batch looks its keys up there: dates
in which a key already lies are read and rewritten without it, other dates of the batch only get new files. So a
re-imported event costs the day it lies in, not the history of its database.

The index is written before the rows, and every date that it names for a key is looked at. A run that dies in between
therefore leaves nothing double: the same batch, run again, finds its own keys. ``compact_index`` keeps the last date of
each key and is run between batches.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import optional_source
from .lineage import durable
from .retention import remove_paths
from .upsert import dedupe_latest, load_order, touched_rows, write_partitions

INDEX = "key_id string, part string, seq long"


def key_id(keys: list[str]) -> Column:
    """Digest of the key values; a NULL is not the same as any text."""
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("n")) for k in keys]))


def upsert_dated(spark: SparkSession, path: str, index_path: str, batch: DataFrame, keys: list[str], part: str, seq_col: str | None,
                 guard: str = "source_wins") -> dict:
    """Applies a batch to the table at ``path``, partitioned by the text column ``part``; the last row of a key wins, by ``seq_col``
    or without it by file and row. With ``guard="newest"`` a stored row with a higher ``seq_col`` stays, so batches may come late,
    in any order or again.
    Returns the counters: rows written, dates rewritten and dates appended to."""
    if guard == "newest" and not seq_col:
        raise ValueError("guard='newest' needs seq_col")
    order = seq_col or "_order"
    batch = batch if seq_col else batch.withColumn(order, load_order())
    batch = dedupe_latest(batch, keys, order)
    batch = durable((batch if seq_col else batch.drop(order)).withColumn("_key", key_id(keys)))
    index = optional_source(spark, index_path, _index_schema(spark))
    last = index.agg(F.max("seq")).first()[0]
    met = durable(batch.select(F.col("_key").alias("key_id")).join(index, "key_id").select("key_id", F.col("part").alias("_part")).distinct())
    dates = durable(met.select(F.col("_part")).distinct())
    same = F.col(part).eqNullSafe(F.col("_part"))
    existing = optional_source(spark, path, batch.drop("_key").schema)
    source = dates.select(F.col("_part").alias(part))
    stored = touched_rows(existing, source, [part]).withColumn("_key", key_id(keys))
    if guard == "newest":
        again = stored.join(batch.select("_key"), "_key", "left_semi").select(*batch.columns)
        batch = durable(dedupe_latest(batch.unionByName(again), keys, seq_col))
    # a row that stays where it lies is entered again, so that the last entry of a key is its date
    batch.select(F.col("_key").alias("key_id"), F.col(part).alias("part"), F.lit((last or 0) + 1).cast("long").alias("seq")).write.mode("append").parquet(index_path)
    inside, outside = batch.join(dates, same, "left_semi"), batch.join(dates, same, "left_anti")
    old = stored.join(batch.select("_key"), "_key", "left_anti")
    rewritten = durable(old.unionByName(inside).drop("_key"))
    # a date that loses its last row has nothing to be overwritten by
    left = rewritten.select(F.col(part).alias("_left")).distinct()
    empty = dates.join(left, F.col("_part").eqNullSafe(F.col("_left")), "left_anti")
    counts = {"dates_rewritten": dates.count(), "dates_appended": outside.select(part).distinct().count()}
    folders = _folders(spark, path, empty, part)
    counts |= write_partitions(rewritten, path, [part])
    outside.drop("_key").write.mode("append").partitionBy(part).parquet(path)
    remove_paths(spark, folders)
    return counts


def _index_schema(spark: SparkSession):
    return spark.createDataFrame([], INDEX).schema


def _folders(spark: SparkSession, path: str, empty: DataFrame, part: str) -> list[str]:
    if empty.isEmpty():
        return []
    files = spark.read.parquet(path).select(F.col(part).alias("_at"), F.regexp_replace("_metadata.file_path", "/[^/]+$", "").alias("folder"))
    return [r.folder for r in files.join(empty, F.col("_at").eqNullSafe(F.col("_part")), "left_semi").select("folder").distinct().collect()]


def compact_index(spark: SparkSession, index_path: str, to_path: str) -> int:
    """Writes the last date of each key to a new index; how many keys it has."""
    index = spark.read.schema(INDEX).parquet(index_path)
    index.groupBy("key_id").agg(F.max_by(F.struct("part", "seq"), "seq").alias("l")).select("key_id", "l.*").write.mode("overwrite").parquet(to_path)
    return spark.read.parquet(to_path).count()
