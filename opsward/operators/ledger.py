"""Load ledger: a stored line per file and attempt, so a load takes each file once and a bad file stops nothing.

A run lists the drop folder, takes the files that the ledger does not call done (or that changed since), loads them in one
read, and writes a line for each: ``done`` with its rows and rejected rows, or ``failed`` with the reason. Lines of
state ``loading`` are written before the rows and name the run's batch; rows go to the batch's own folder. A run that
died leaves ``loading`` lines without an end: the next one removes that folder and takes its files again.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from ..sources.files import optional_source
from ..sources.listing import THREADS, list_files, name_keys
from .lineage import durable
from .retention import remove_paths

_TEXT, _LONG, _INT, _TIME = StringType(), LongType(), IntegerType(), TimestampType()
LEDGER = StructType([StructField(name, kind) for kind, names in (
    (_TEXT, "path uri name host instance dbname feed state message batch"), (_LONG, "bytes n_rows n_rejects"),
    (_INT, "file_no n_files"), (_TIME, "modified at")) for name in names.split()])
ENDED = ("done", "failed")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return optional_source(spark, path, LEDGER)


def latest_state(ledger: DataFrame) -> DataFrame:
    """The last line of each file; within one moment an end stands after its begin."""
    last = F.struct("at", F.col("state").isin(*ENDED).alias("ended"))
    return ledger.groupBy("path").agg(F.max_by(F.struct(*[c for c in ledger.columns if c != "path"]), last).alias("l")).select("path", "l.*")


def pending(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are not done, or whose size or time is another than when they were."""
    done = latest_state(ledger).where("state = 'done'").select("path", "bytes", "modified")
    return files.join(done, ["path", "bytes", "modified"], "left_anti")


def numbered(files: DataFrame) -> DataFrame:
    """Adds file_no and n_files: the place of a file among those of its feed, by name."""
    w = Window.partitionBy("feed")
    return files.withColumns({"file_no": F.row_number().over(w.orderBy("name", "path")), "n_files": F.count(F.lit(1)).over(w).cast("int")})


def _opens(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except (PySparkException, Py4JJavaError):
        return False


def load_pending(spark: SparkSession, base: str, ledger_path: str, target: str, rejects: str, schema: str, required: list[str],
                 instance_feeds: list[str] | None = None, feeds: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """Loads the Parquet files of ``base`` that are pending (of ``feeds`` if given) and returns this run's lines.

    Good rows go to ``target/batch=<id>`` with the keys of their file, rows that lack a ``required`` column to ``rejects/batch=<id>``. A file
    fails if its name has no keys, if it cannot be opened, or if fewer rows come out of it than its footer
    names; none of its rows is loaded then."""
    ledger = read_ledger(spark, ledger_path)
    ended = F.max(F.col("state").isin(*ENDED))
    dead = [r.batch for r in ledger.groupBy("batch").agg(ended.alias("ended")).where(~F.col("ended")).collect()]
    remove_paths(spark, [f"{p}/batch={b}" for p in (target, rejects) for b in dead])
    files = list_files(spark, base, glob)
    files = files.withColumns(name_keys(F.col("name"), instance_feeds or []))
    if feeds:
        files = files.where(F.col("feed").isin(feeds))
    todo = durable(numbered(pending(files, ledger)))
    if todo.isEmpty():
        return spark.createDataFrame([], LEDGER)
    batch = uuid.uuid4().hex[:16]

    def note(lines: DataFrame) -> None:
        lines.select(*LEDGER.names).coalesce(1).write.mode("append").parquet(ledger_path)

    blank = {"n_rows": F.lit(None).cast("long"), "n_rejects": F.lit(None).cast("long"), "message": F.lit(None).cast("string")}
    note(todo.withColumns({**blank, "state": F.lit("loading"), "batch": F.lit(batch), "at": F.current_timestamp()}))
    paths = [r.path for r in todo.where("feed is not null").select("path").toLocalIterator()]
    outcome = _outcome(spark, todo, paths, schema, required) if paths else todo.withColumns({**blank, "state": F.lit("failed")})
    outcome = durable(outcome.withColumn("message", F.when(F.col("feed").isNull(), F.lit("the name holds no keys")).otherwise(F.col("message")))
                      .withColumns({"state": F.when(F.col("feed").isNull(), F.lit("failed")).otherwise(F.col("state")), "batch": F.lit(batch), "at": F.current_timestamp()}))
    if paths:
        good = outcome.where("state = 'done' and n_rows + n_rejects > 0").select(F.col("uri").alias("_uri"), "host", "instance", "dbname", "feed")
        rows = _rows(spark, paths, schema).join(good, "_uri")
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required], F.lit(True))
        rows.where(whole).drop("_uri").write.mode("overwrite").parquet(f"{target}/batch={batch}")
        rows.where(~whole).drop("_uri").write.mode("overwrite").parquet(f"{rejects}/batch={batch}")
    note(outcome)
    return outcome.select(*LEDGER.names)


def _rows(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    read = spark.read.option("ignoreCorruptFiles", True).schema(schema).parquet(*paths)
    return read.select(*read.columns, F.col("_metadata.file_path").alias("_uri"))


def _outcome(spark: SparkSession, todo: DataFrame, paths: list[str], schema: str, required: list[str]) -> DataFrame:
    """The end of each file: rows that came out of it against those that its footer names."""
    rows = _rows(spark, paths, schema)
    columns = [c for c in rows.columns if c != "_uri"]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required], F.lit(True))
    # every column is looked at, so every page of a file is read
    seen = rows.select("_uri", whole.alias("whole"), F.xxhash64(*columns).alias("h")).groupBy("_uri").agg(
        F.count(F.when(F.col("whole"), F.col("h"))).alias("n_rows"), F.count(F.when(~F.col("whole"), F.col("h"))).alias("n_rejects"))
    named = rows.select("_uri").groupBy("_uri").agg(F.count(F.lit(1)).alias("named"))  # no column: counts of the footers
    got = durable(todo.join(named, F.col("uri") == F.col("_uri"), "left").drop("_uri").join(seen, F.col("uri") == F.col("_uri"), "left").drop("_uri"))
    # a file without rows is either empty or unreadable: only these are opened once more
    silent = [r.path for r in got.where("named is null and feed is not null").select("path").toLocalIterator()]
    with ThreadPoolExecutor(THREADS) as pool:
        bad = [p for p, ok in zip(silent, pool.map(lambda p: _opens(spark, p), silent)) if not ok]
    unread = F.col("path").isin(bad) if bad else F.lit(False)
    out = F.coalesce("n_rows", F.lit(0)) + F.coalesce("n_rejects", F.lit(0))
    short = out != F.coalesce("named", F.lit(0))
    message = F.when(unread, F.lit("the file cannot be read")).when(short, F.format_string("%d of %d rows could be read", out, F.coalesce("named", F.lit(0))))
    return got.withColumn("message", message).withColumns({
        "state": F.when(F.col("message").isNull(), "done").otherwise("failed"), "n_rows": F.coalesce("n_rows", F.lit(0)), "n_rejects": F.coalesce("n_rejects", F.lit(0))})


def progress_lines(lines: DataFrame) -> DataFrame:
    """(feed, file_no, line): what a run says of each file."""
    line = F.concat(F.col("feed"), F.lit(" - "), F.col("name"), F.format_string(" (%d/%d) ", "file_no", "n_files"),
                    F.when(F.col("state") == "done", F.format_string("%d rows, %d rejected", "n_rows", "n_rejects")).otherwise(F.concat(F.lit("failed: "), F.col("message"))))
    return lines.where(F.col("state").isin(*ENDED)).select("feed", "file_no", line.alias("line"))
