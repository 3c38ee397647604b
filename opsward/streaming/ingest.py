"""Drop-folder ingestion as a stream: ``readStream`` on files -> ``foreachBatch(upsert)``.

The checkpoint gives once-only file handling; ``availableNow`` drains what is
there and stops (the scheduled re-scan of the original, without re-reading old
files).  Each micro-batch is an idempotent upsert of the touched partitions, so
a replayed epoch after an executor loss writes the same result again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.dated import upsert_dated
from ..operators.upsert import upsert_into_path


def ingest_drop_folder(spark: SparkSession, drop_path: str, schema: StructType, target_path: str,
                       checkpoint_path: str, keys: list[str], seq_col: str, partition_cols: list[str],
                       fmt: str = "parquet", max_files_per_trigger: int | None = None,
                       guard: str = "newest") -> None:
    def apply_batch(batch: DataFrame, epoch_id: int) -> None:
        upsert_into_path(spark, target_path, batch, keys, seq_col, partition_cols, guard=guard, fmt=fmt)

    _drain(_drop_files(spark, drop_path, schema, fmt, max_files_per_trigger), checkpoint_path, apply_batch)


def ingest_dated(spark: SparkSession, drop_path: str, schema: StructType, target_path: str, index_path: str, checkpoint_path: str,
                 keys: list[str], part: str, seq_col: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> list[dict]:
    """The same into an event table by date with a key index: a micro-batch of new events only adds files to its dates; dates
    are rewritten where a key of the batch already lies, and the newest row of a key stays whatever order the files come in.
    Returns the counters of each micro-batch."""
    counters: list[dict] = []

    def apply_batch(batch: DataFrame, epoch_id: int) -> None:
        counters.append(upsert_dated(spark, target_path, index_path, batch, keys, part, seq_col, guard="newest"))

    _drain(_drop_files(spark, drop_path, schema, fmt, max_files_per_trigger), checkpoint_path, apply_batch)
    return counters


def _drop_files(spark: SparkSession, path: str, schema: StructType, fmt: str, most_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.load(path)


def _drain(stream: DataFrame, checkpoint_path: str, apply_batch: Callable[[DataFrame, int], None]) -> None:
    q = (stream.writeStream.foreachBatch(apply_batch)
         .option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
