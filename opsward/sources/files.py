"""File sources: typed delimited reads, drop-folder scans by key pattern, keys from paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


SLICES_HELD = 200_000  # listed slices that are given to every task; a longer list is joined as Spark chooses


def read_typed_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True,
                   corrupt_col: str | None = "_corrupt_record") -> DataFrame:
    """Declared types, no inference; malformed rows kept with their raw text (PERMISSIVE)."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if corrupt_col:
        schema = StructType(list(schema.fields)).add(corrupt_col, "string")
    reader = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
    if corrupt_col:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_col)
    return reader.csv(path)


def clustered(df: DataFrame, partition_cols: list[str]) -> DataFrame:
    """Cluster rows by the output partition columns before a partitioned write.

    ``REBALANCE`` keeps each folder's rows together (few files per folder instead
    of one per task) and lets AQE split a folder that holds a skewed share.
    """
    return df.hint("rebalance", *partition_cols) if partition_cols else df


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = clustered(df, partition_by or []).write.mode("overwrite").option("header", True) \
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def glob_for(base: str, parts: list[tuple[str, str | None]]) -> str:
    """Folder glob ``base/k1=v1/k2=*`` — a missing part matches anything."""
    segs = [f"{k}={v if v not in (None, '', '*') else '*'}" for k, v in parts]
    return "/".join([base.rstrip("/")] + segs)


def scan_by_key_pattern(spark: SparkSession, base: str, parts: list[tuple[str, str | None]],
                        schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Drop-folder scan: read every file under the key pattern; zero matches -> empty result."""
    pattern = glob_for(base, parts)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    matches = fs.globStatus(jvm_path)
    if matches is None or len(matches) == 0:
        return spark.createDataFrame([], schema)
    return (spark.read.format(fmt).schema(schema).option("basePath", base)
            .load(pattern))


def scan_slices(spark: SparkSession, path: str, slices: DataFrame, keys: list[str], fmt: str = "parquet") -> DataFrame:
    """The rows of many key slices in one scan of a table partitioned by ``keys``. ``slices`` is a stored list (a row per slice);
    its keys reach the scan as dynamic partition pruning, so only folders of listed slices are read."""
    listed = slices.select(*keys)
    for k in keys:
        listed = listed.where(F.col(k) >= "")  # a predicate on the list is what lets its keys prune the scan
    return spark.read.format(fmt).load(path).join(F.broadcast(listed) if slices.count() <= SLICES_HELD else listed, keys, "left_semi")


def keys_from_path(df: DataFrame, pattern: str, names: list[str], path_col: str = "_metadata.file_path") -> DataFrame:
    """Extract key fields from the file path with one regex (group i -> names[i-1])."""
    path = F.col(path_col)
    return df.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def optional_source(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """A source that may be absent: missing -> empty DataFrame with the feed schema."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).schema(schema).load(path)
