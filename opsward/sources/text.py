"""Line-oriented text: ``(file, line_no, line)`` from files or from a text column.

Config files are read by ``read_lines``, a file in a row.  Scripts of any size are read by ``script_lines``, by byte
range: a file is as many tasks as it has splits, and its lines still get exact numbers.  Text already stored in a
table column is split per row, which parallelises by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # the keyword matters: text() resets a prior option('wholetext') to its default
    df = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines_of(df, "file", "value")


def script_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Numbered lines (1-based) of all text files below ``path``; lines end at ``\\n`` (a ``\\r`` before it goes), a final newline
    adds no line, an empty file has none.

    The splits are read once into a table in the shared scratch folder, each line with its split and its place in
    the task, so another number of executors in a later stage cannot cut the files differently.  A line's number is its place in the split
    plus the lines of the file's earlier splits: one row per split is counted, and a running sum over the
    splits' start bytes adds them up.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"),
                                   F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "\r$", "").alias("line"))
    held = scratch_path(spark, "script-lines")
    # many small files share a task: a file's opening counts 4 MB otherwise, so a task would take 32 of them
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "65536")
    try:
        raw.write.parquet(held)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    lines = spark.read.schema(raw.schema).parquet(held)
    splits = lines.groupBy("file", "split_start").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split_start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.join(splits, ["file", "split_start"]).select("file", (F.col("place") + F.col("shift")).alias("line_no"), "line")


def write_scripts(lines: DataFrame, path: str, file_col: str = "file", order_col: str = "line_no", text_col: str = "line") -> str:
    """One text file per ``file_col`` value (folder ``script=<value>``), its lines in order."""
    (lines.select(F.col(file_col).alias("script"), F.col(order_col).alias("place"), F.col(text_col).alias("value"))
          .repartition("script").sortWithinPartitions("script", "place").select("script", "value")
          .write.mode("overwrite").partitionBy("script").text(path))
    return path


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Explode a text column into numbered lines (1-based); a final newline adds no line."""
    body = F.regexp_replace(F.col(text_col), r"\r?\n$", "")
    return df.select(
        F.col(id_col).alias("file"),
        F.posexplode(F.split(body, r"\r?\n")).alias("pos", "line"),
    ).select("file", (F.col("pos") + 1).alias("line_no"), "line")


def write_lines(lines: DataFrame, path: str, text_col: str = "line", order_col: str = "line_no") -> str:
    """Write a small config-sized text file (one file, in line order)."""
    (lines.orderBy(order_col).select(F.col(text_col).alias("value"))
        .coalesce(1).write.mode("overwrite").text(path))
    return path
