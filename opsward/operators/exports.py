"""Exports with a manifest: rows per key from the file footers, stored beside the files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import clustered
from ..sources.listing import list_files
from .retention import remove_paths

MANIFEST = "_manifest"  # readers of the export skip folders that begin with an underscore


def footer_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Rows and files per partition: no column is read, so the counts are those of the footers."""
    return (spark.read.parquet(path).select(*keys, F.col("_metadata.file_path").alias("_file")).groupBy(*keys, "_file").agg(F.count(F.lit(1)).alias("n"))
            .groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_files")))


def export_with_manifest(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Writes ``df`` partitioned by ``keys`` (replacing the partitions it holds) and the manifest of all that lies there now."""
    spark = df.sparkSession
    clustered(df, keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    footer_counts(spark, path, keys).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return spark.read.parquet(f"{path}/{MANIFEST}")


def check_manifest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Keys whose files no longer hold what the manifest says: (keys, n_rows said, n_rows there)."""
    said = spark.read.parquet(f"{path}/{MANIFEST}").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n_rows").alias("said"))
    there = footer_counts(spark, path, keys).select(*keys, F.col("n_rows").alias("there"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    j = there.join(said, same, "full_outer").where(~F.col("said").eqNullSafe(F.col("there")))
    return j.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], "said", "there")


def purge_files(spark: SparkSession, base: str, as_of, days: int, glob: str | None = None, dry_run: bool = True) -> DataFrame:
    """Files below ``base`` that are at least ``days`` days old at ``as_of`` (by modification time), as rows with size and
    age; unless it is a dry run they are deleted, several at a time."""
    age = F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp("modified")) / 86_400)
    old = list_files(spark, base, glob).withColumn("age_days", age.cast("int")).where(F.col("age_days") >= days)
    rows = old.select("path", "uri", "name", "bytes", "age_days").collect()  # names of what is to go, as any deletion needs
    if not dry_run:
        remove_paths(spark, [r.uri for r in rows])
    return spark.createDataFrame([(r.name, r.bytes, r.age_days) for r in rows], "name string, bytes long, age_days int")
