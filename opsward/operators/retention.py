"""Retention and purge: age horizons, cascades, keep-newest-N, empty groups.

All of them return the *candidate* rows (dry run) or the kept rows; deleting is
writing the complement, which for date-partitioned tables reduces to dropping
whole partitions.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.time import whole_days
from ..session import scratch_path
from .lineage import durable
from .upsert import touched_rows, write_partitions


def purge_by_age(df: DataFrame, ts_col: str, as_of: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, purged) for ``ts < as_of - days``; NULL stamps are kept."""
    expired = F.col(ts_col) < (as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    return df.where(~expired | F.col(ts_col).isNull()), df.where(expired)


def purge_cascade(children: DataFrame, expiring_parents: DataFrame, child_keys: list[str],
                  parent_keys: list[str]) -> DataFrame:
    """Children that survive: no key match among the expiring parents (children go first)."""
    p = expiring_parents.select(*[F.col(pk).alias(ck) for pk, ck in zip(parent_keys, child_keys)])
    return children.join(p, child_keys, "left_anti")


def empty_groups(parents: DataFrame, children: DataFrame, parent_keys: list[str], child_keys: list[str]) -> DataFrame:
    c = children.select(*[F.col(ck).alias(pk) for pk, ck in zip(parent_keys, child_keys)])
    return parents.join(c, parent_keys, "left_anti")


def purge_whole_days(df: DataFrame, ts_col: str, as_of: Column, days: int) -> DataFrame:
    """``find -mtime +N``: completed days of age strictly greater than N."""
    return df.where(whole_days(F.col(ts_col), as_of) > days)


def keep_newest_n(df: DataFrame, entity_cols: list[str], ts_col: str, id_col: str, n: int,
                  mode: str = "count", as_of: Column | None = None) -> DataFrame:
    """Removal candidates when more than ``n`` copies exist per entity.

    ``mode='count'``: everything older than the n-th newest copy.
    ``mode='count_and_age'``: of those, only copies at least ``n`` whole days old.

    The n newest per entity come from a row_number filter, which Catalyst turns
    into a partial WindowGroupLimit *before* the shuffle, so a hot entity ships
    at most n rows per map task.  The n-th newest is then joined back as a
    per-entity bound (equi-join; AQE splits a skewed side).
    """
    w = Window.partitionBy(*entity_cols).orderBy(F.col(ts_col).desc(), F.col(id_col).desc())
    top = df.select(*entity_cols, ts_col, id_col).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    bound = (top.groupBy(*entity_cols)
                .agg(F.count(F.lit(1)).alias("_k"), F.min(F.struct(F.col(ts_col), F.col(id_col))).alias("_nth"))
                .where(F.col("_k") == n).select(*entity_cols, "_nth"))
    cand = df.join(bound, entity_cols, "inner").where(F.struct(F.col(ts_col), F.col(id_col)) < F.col("_nth")).drop("_nth")
    if mode == "count":
        return cand
    if mode == "count_and_age":
        if as_of is None:
            raise ValueError("count_and_age needs as_of")
        return cand.where(whole_days(F.col(ts_col), as_of) >= n)
    raise ValueError(mode)


def next_version(folder_names: DataFrame, name_col: str = "folder", days: DataFrame | None = None) -> DataFrame:
    """``<yyyymmdd>_<nn>`` folders -> next free ``nn`` per day: max + 1 (two digits or more), ``00`` for a day of
    ``days`` (column day) without a folder."""
    day = F.regexp_extract(F.col(name_col), r"^([0-9]{8})_([0-9]{2,})$", 1)
    nn = F.regexp_extract(F.col(name_col), r"^([0-9]{8})_([0-9]{2,})$", 2).try_cast("int")
    last = folder_names.select(day.alias("day"), nn.alias("nn")).where(F.col("day") != "").groupBy("day").agg(F.max("nn").alias("nn"))
    if days is not None:
        last = days.select("day").distinct().join(last, "day", "full_outer")
    n = F.coalesce(F.col("nn") + 1, F.lit(0)).cast("string")
    return last.select("day", F.concat(F.col("day"), F.lit("_"), F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0"))).alias("next_folder"))


def apply_purge(spark, path: str, ts_col: str, as_of: Column, days: int, partition_col: str, fmt: str = "parquet",
                children: list[tuple] | None = None) -> dict:
    """Purge by age, applied to tables on shared storage. ``partition_col`` is the date of ``ts_col``.

    ``children``: (path, child key, parent key, partition columns[, children of its own]); their rows of expiring parents
    go, the lowest level first, so a run that dies leaves no row without its parent. Only partitions that hold expiring
    rows are rewritten, and those that nothing stays in are removed, whatever their value (NULL and escaped ones too).
    Returns the rows purged from each path."""
    parent = spark.read.format(fmt).load(path)
    _, expired = purge_by_age(parent, ts_col, as_of, days)
    counts: dict[str, int] = {}

    def cascade(rows: DataFrame, below: list[tuple] | None) -> None:
        for child_path, ck, pk, parts, *lower in below or []:
            gone = rows.select(F.col(pk).alias("_gone")).where("_gone is not null").distinct()
            child = spark.read.format(fmt).load(child_path)
            marked = child.join(gone, F.col(ck) == F.col("_gone"), "left").withColumn("_hit", F.col("_gone").isNotNull()).drop("_gone")
            held = scratch_path(spark, "purge-marked")  # one join; what follows reads its result
            marked.write.parquet(held)
            marked = spark.read.schema(marked.schema).parquet(held)
            cascade(marked.where("_hit").drop("_hit"), lower[0] if lower else None)
            counts[child_path] = _replace(spark, child_path, marked, parts, fmt, stored=True)

    cascade(expired, children)
    hit = F.coalesce(F.col(ts_col) < (as_of - F.expr(f"INTERVAL {int(days)} DAYS")), F.lit(False))
    counts[path] = _replace(spark, path, parent.withColumn("_hit", hit), [partition_col], fmt)
    return counts


def _replace(spark, path: str, marked: DataFrame, parts: list[str], fmt: str, stored: bool = False) -> int:
    """Rewrites the partitions that hold rows marked ``_hit`` without these; how many rows those are. Partitions that nothing stays
    in are removed; their folders are named by the files in them, so no value has to be written as a folder name again.
    ``stored``: ``marked`` is not read from ``path``, so it can be written there as it is."""
    tally = marked.groupBy(*parts).agg(F.count(F.when(F.col("_hit"), 1)).alias("_gone"), F.count(F.lit(1)).alias("_all")).where("_gone > 0")
    tally = durable(tally)  # a row per partition that is touched
    n = tally.agg(F.coalesce(F.sum("_gone"), F.lit(0))).first()[0]
    if not n:
        return 0
    empty = tally.where("_gone = _all").select(*[F.col(c).alias(f"_e_{c}") for c in parts])
    files = spark.read.format(fmt).load(path).select(*parts, F.col("_metadata.file_path").alias("_file"))
    in_empty = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in parts])
    of_empty = files.join(empty, in_empty, "left_semi").select("_file").distinct()
    folders = [r[0] for r in durable(of_empty.select(F.regexp_replace("_file", "/[^/]+$", "").alias("_folder")).distinct()).toLocalIterator()]
    stay = touched_rows(marked, tally.where("_gone < _all"), parts).where("not _hit").drop("_hit")
    write_partitions(stay if stored else durable(stay), path, parts, fmt)
    remove_paths(spark, folders)
    return n


def remove_paths(spark, paths: list[str], threads: int = 16) -> int:
    """Deletes files or folders given as URIs, several at a time; how many were there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove(uri: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        return p.getFileSystem(conf).delete(p, True)

    with ThreadPoolExecutor(threads) as pool:
        return sum(pool.map(remove, paths))
