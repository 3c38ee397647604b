"""Feeds published as JSON documents, several at a time, each with its own outcome."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPORT = "feed string, rows_moved long, code int, reason string"


def publish_feeds(spark: SparkSession, feeds: dict[str, Callable[[], DataFrame]], base: str, only: Iterable[str] | None = None,
                  workers: int = 4) -> DataFrame:
    """Writes every feed (or those named in ``only``) below ``base`` as one JSON document per row, and returns a line per feed:
    the rows moved, observed on the write itself, and 0, or 1 with the kind of error for a feed that could not be read or
    written. A failing feed does not stop the others; a name that is no feed is a failing one."""
    def publish(name: str) -> tuple:
        seen = Observation(f"published_{name}")
        try:
            if name not in feeds:
                return name, 0, 1, "NO_SUCH_FEED"
            df = feeds[name]()
            docs = df.select(F.to_json(F.struct(*df.columns)).alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
            docs.write.mode("overwrite").text(f"{base}/{name}")
            return name, seen.get["n"], 0, None
        except PySparkException as e:
            return name, 0, 1, e.getCondition() or type(e).__name__
        except Py4JError as e:
            return name, 0, 1, type(e).__name__

    names = list(feeds if only is None else dict.fromkeys(only))
    with ThreadPoolExecutor(workers) as pool:
        return spark.createDataFrame(list(pool.map(publish, names)), REPORT)  # a row per feed


def overall_code(report: DataFrame) -> DataFrame:
    """Feeds, rows moved and the sum of the codes."""
    return report.agg(F.count(F.lit(1)).alias("n_feeds"), F.coalesce(F.sum("rows_moved"), F.lit(0)).alias("rows_moved"),
                      F.coalesce(F.sum("code"), F.lit(0)).alias("code"))
