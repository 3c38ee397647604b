"""Stored, mergeable statistics: one row of sketches per partition and column, merged when asked.

A run reads only partitions that have no statistics yet. Counts, nulls, least and greatest value are exact;
distinct counts come from HyperLogLog sketches (2^12 registers: a relative standard error of 1.6 %), quantiles from KLL sketches
(k = 200: a rank error of about 1.7 %). With ``fraction`` the rows are a Bernoulli sample: the row count is scaled up and
its 95 % bound stated; distinct counts are then those of the sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import optional_source

STATS = ("part string, column string, fraction double, n long, n_null long, least double, greatest double, least_text string, greatest_text string, "
         "distinct_sketch binary, quantile_sketch binary")
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def missing_parts(table: DataFrame, part: str, stats: DataFrame) -> DataFrame:
    """Partition values without statistics."""
    parts = table.select(F.col(part).cast("string").alias("_part")).distinct()  # partition values: no column of the files is read
    return parts.join(stats.select(F.col("part").alias("_part")).distinct(), "_part", "left_anti")


def update_statistics(spark: SparkSession, table: DataFrame, part: str, columns: list[str], path: str, fraction: float = 1.0, seed: int = 7) -> int:
    """Adds statistics of the partitions that have none; how many those are. ``table`` is partitioned by ``part`` (no NULL partition)."""
    have = optional_source(spark, path, spark.createDataFrame([], STATS).schema)
    new = missing_parts(table, part, have).persist()
    n_new = new.count()
    if n_new:
        rows = table.join(F.broadcast(new) if n_new < 10_000 else new, F.col(part).cast("string") == F.col("_part"))
        if fraction < 1:
            rows = rows.sample(fraction=fraction, seed=seed)
        kinds = dict(table.dtypes)
        facts = []
        for i, c in enumerate(columns):
            number = kinds[c].split("(")[0] in NUMBERS or kinds[c].startswith("decimal")
            v, text = F.col(c), F.col(c).cast("string")
            as_number = v.cast("double") if number else F.lit(None).cast("double")
            facts.append(F.struct(
                F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count(F.when(v.isNull(), 1)).alias("n_null"),
                F.min(as_number).alias("least"), F.max(as_number).alias("greatest"),
                (F.lit(None).cast("string") if number else F.min(text)).alias("least_text"), (F.lit(None).cast("string") if number else F.max(text)).alias("greatest_text"),
                F.hll_sketch_agg(text, F.lit(12)).alias("distinct_sketch"),
                (F.kll_sketch_agg_double(as_number) if number else F.lit(None).cast("binary")).alias("quantile_sketch")).alias(f"_f{i}"))
        got = rows.groupBy(F.col("_part").alias("part")).agg(*facts)
        flat = got.select("part", F.explode(F.array(*[F.col(f"_f{i}") for i in range(len(columns))])).alias("f")).select("part", F.lit(float(fraction)).alias("fraction"), "f.*")
        names = [x.split()[0] for x in STATS.split(", ")]
        flat.select(*names).write.mode("append").parquet(path)
    new.unpersist()
    return n_new


def profile(stats: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column over all partitions, from the stored rows alone."""
    merged = stats.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum(F.col("n") / F.col("fraction")).alias("n"), F.sum(F.col("n_null") / F.col("fraction")).alias("n_null"),
        F.sqrt(F.sum(F.col("n") * (1 - F.col("fraction")) / (F.col("fraction") * F.col("fraction")))).alias("sd"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.min("least_text").alias("least_text"), F.max("greatest_text").alias("greatest_text"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"), F.kll_merge_agg_double("quantile_sketch").alias("_q"))
    probes = [F.when(F.col("_q").isNotNull() & F.col("least").isNotNull(), F.kll_sketch_get_quantile_double("_q", F.lit(q))).alias(f"q{round(100 * q)}") for q in quantiles]
    return merged.select("column", "n_parts", F.round("n").cast("long").alias("n"), F.round("n_null").cast("long").alias("n_null"), (1.96 * F.col("sd")).alias("n_bound"),
                         "least", "greatest", "least_text", "greatest_text", "n_distinct", *probes)
