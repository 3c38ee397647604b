"""Catalog worklists and profiling: row counts, column profiles, statements, chunked worklists, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import durable


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``count(*)`` of every table in one job, with a grid line (name 40 left, count 20 right; longer ones in full)."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out.select("table_name", "n_rows",
                      F.concat(_padded(F.col("table_name"), 40, F.rpad), _padded(F.col("n_rows").cast("string"), 20, F.lpad)).alias("grid_line"))


def _padded(text, width: int, pad):
    return pad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


VALUES_A_TASK = 1_000_000


def quantiles(df: DataFrame, cols: list[str], points: tuple[float, ...] = (0.25, 0.5, 0.75), approximate: bool = False) -> DataFrame:
    """Per column its quantiles: interpolated ones as ``percentile`` gives them, or ``approximate`` ones of bounded size in one pass."""
    if not approximate:
        return _exact_quantiles(df, cols, points)
    one = df.agg(*[F.percentile_approx(c, list(points)).alias(f"_q{i}") for i, c in enumerate(cols)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"_q{i}")[j].cast("double").alias(f"q{round(100 * q)}") for j, q in enumerate(points)])
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


def _exact_quantiles(df: DataFrame, cols: list[str], points: tuple[float, ...]) -> DataFrame:
    """Values are counted, then cut into ranges of bounded size; the rows of all earlier ranges say which ranges hold a wanted
    rank, and only those are numbered. No task holds a column's values, however many differ."""
    counts = None
    for i, c in enumerate(cols):
        vc = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).select(F.lit(i).alias("_i"), "_v", "_n")
        counts = vc if counts is None else counts.unionByName(vc)
    counts = durable(counts)
    n_ranges = max(1, -(-counts.count() // VALUES_A_TASK))
    # stored, so the ranges (sampled) are the same for values and sizes
    held = durable(counts.repartitionByRange(n_ranges, "_i", "_v").withColumn("_pid", F.spark_partition_id()))
    per = Window.partitionBy("_i")
    sizes = held.groupBy("_i", "_pid").agg(F.sum("_n").alias("_size"))
    sizes = sizes.select("_i", "_pid", "_size", F.sum("_size").over(per).alias("_total"),
                         F.coalesce(F.sum("_size").over(per.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    at = F.explode(F.array(*[F.struct(F.lit(j).alias("_j"), ((F.col("_total") - 1) * F.lit(float(p))).alias("_pos")) for j, p in enumerate(points)])).alias("_at")
    wanted = sizes.select("*", at).select("_i", "_pid", "_off", "_size", "_at.*")
    wanted = wanted.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
    wanted = durable(wanted.where((F.col("_rank") >= F.col("_off")) & (F.col("_rank") < F.col("_off") + F.col("_size"))))  # two rows a point at most
    near = held.join(F.broadcast(wanted.select("_i", "_pid", "_off").distinct()), ["_i", "_pid"])
    run = near.withColumn("_end", F.col("_off") + F.sum("_n").over(Window.partitionBy("_i", "_pid").orderBy("_v"))).drop("_off")
    hit = run.join(F.broadcast(wanted), ["_i", "_pid"]).where((F.col("_end") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_end")))
    pair = hit.groupBy("_i", "_j", "_pos").agg(F.min_by("_v", "_rank").alias("_lo"), F.max_by("_v", "_rank").alias("_hi"))
    pos, lo, hi = F.col("_pos"), F.col("_lo"), F.col("_hi")
    pair = pair.withColumn("_q", F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi))
    found = pair.groupBy("_i").agg(*[F.max(F.when(F.col("_j") == j, F.col("_q"))).alias(f"q{round(100 * q)}") for j, q in enumerate(points)])
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "_i int, column_name string")
    return names.join(found, "_i", "left").drop("_i")


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, n) for every column value.

    One typed aggregation per column (columnar read of that column only, partial
    aggregation before the shuffle); values become text only after reduction.
    """
    out = None
    for c in cols:
        vc = (df.groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
                .select(F.lit(c).alias("column_name"), F.col("_v").cast("string").alias("value"), "n"))
        out = vc if out is None else out.unionByName(vc)
    return out


def column_profile(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: rows, NULLs, distinct values, min, max (as text).

    One scan for rows/NULLs/min/max; distinct counts either exact (from the
    value-count aggregation, not an N-way Expand) or HyperLogLog++.
    """
    cols = cols or df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"_nul{i}"),
                 F.min(c).cast("string").alias(f"_min{i}"), F.max(c).cast("string").alias(f"_max{i}")]
        if approximate:
            aggs.append(F.approx_count_distinct(c).alias(f"_dst{i}"))
    one = df.agg(*aggs)
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("n_rows"), F.col(f"_nul{i}").cast("long").alias("n_nulls"),
                 (F.col(f"_dst{i}").cast("long") if approximate else F.lit(None).cast("long")).alias("n_distinct"),
                 F.col(f"_min{i}").alias("min_value"), F.col(f"_max{i}").alias("max_value"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")
    if approximate:
        return long
    dist = value_counts(df, cols).groupBy("column_name").agg(F.count("value").alias("n_distinct_exact"))
    return (long.join(F.broadcast(dist), "column_name", "left")
                .select("column_name", "n_rows", "n_nulls", F.coalesce("n_distinct_exact", F.lit(0)).alias("n_distinct"),
                        "min_value", "max_value"))


def frequent_values(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """Top-k values per column by count, ties broken by the value text (unique ranking)."""
    vc = value_counts(df, cols)
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def compact(df: DataFrame, path: str, keys: list[str], n_files: int | None = None) -> str:
    """Rewrite restoring clustering: range-partition by the keys, sort inside each file."""
    n = n_files or max(1, df.rdd.getNumPartitions())
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return path


def split_in_chunks(spark: SparkSession, df: DataFrame, order_cols: list[str], n_chunks: int,
                    extra: int = 10, n_ranges: int | None = None) -> DataFrame:
    """Global row number without a single-partition window, then chunk = (rn-1) // (n // p + extra).

    Range-partition by the order keys, number rows inside each range, and add the
    row count of all earlier ranges (one small row per range, broadcast).
    """
    n_ranges = n_ranges or max(1, spark.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(n_ranges, *order_cols).withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid").orderBy(*order_cols)
    # materialised once so the range boundaries (sampled) are the same for rows and sizes
    local = durable(ranged.withColumn("_lrn", F.row_number().over(w)))
    sizes = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    wo = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_cnt").over(wo), F.lit(0)).alias("_off"),
                           F.sum("_cnt").over(Window.partitionBy()).alias("_total"))
    j = local.join(offsets, "_pid")  # one row per range
    rn = (F.col("_off") + F.col("_lrn")).cast("long")
    size = F.floor(F.col("_total") / n_chunks) + extra
    return j.select(*df.columns, rn.alias("rn"), F.floor((rn - 1) / size).cast("int").alias("chunk"))


def ordered_lists(spark: SparkSession, df: DataFrame, group_cols: list[str], item_col: str, max_items: int,
                  sep: str = ",") -> DataFrame:
    """Comma lists of ``item_col`` per group, in item order, cut into chunks of at most ``max_items``.

    Ranks come from the global range numbering (no per-group window), minus the
    group's first global number; each (group, chunk) list is bounded.
    """
    numbered = split_in_chunks(spark, df.select(*group_cols, item_col), [*group_cols, item_col], 1)
    first = numbered.groupBy(*group_cols).agg(F.min("rn").alias("_first"))
    ranked = numbered.join(first, group_cols).withColumn("_rank", F.col("rn") - F.col("_first"))
    chunked = ranked.withColumn("chunk", F.floor(F.col("_rank") / max_items).cast("int"))
    return chunked.groupBy(*group_cols, "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", item_col))), lambda s: s[item_col]), sep)
        .alias("item_list"),
        F.count(F.lit(1)).alias("n_items"))
