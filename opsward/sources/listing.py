"""Files as rows: listings with size and time, keys from file names, files named by key."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

THREADS = 16


def list_files(spark: SparkSession, base: str, glob: str | None = None) -> DataFrame:
    """(path, uri, name, bytes, modified) of all files below ``base``; no file is opened. ``path`` is for reading, ``uri`` is what
    ``_metadata.file_path`` says of the file's rows. A missing folder has no files."""
    schema = "path string, uri string, name string, bytes long, modified timestamp"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    m, found = F.col("_metadata"), reader.load(base)
    files = found.select("path", m["file_path"].alias("uri"), m["file_name"].alias("name"), m["file_size"].alias("bytes"),
                         m["file_modification_time"].alias("modified"))
    # a scan has no split for an empty file: those that only the listing names are asked for one by one
    named = spark.createDataFrame([(u,) for u in found.inputFiles()], "uri string")
    empty = []
    plain = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+:)/+", "$1/").alias("at")  # noqa: E731  file:/x and file:///x are one
    for r in named.withColumn("at", plain("uri")).join(files.select(plain("uri")), "at", "left_anti").toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r.uri))
        empty.append((at.toString(), r.uri, at.getName(), 0, fs.getFileStatus(at).getModificationTime() / 1000))
    if not empty:
        return files
    extra = spark.createDataFrame(empty, "path string, uri string, name string, bytes long, t double")
    return files.unionByName(extra.withColumn("modified", F.timestamp_seconds("t")).drop("t"))


def name_keys(name: Column, instance_feeds: list[str]) -> dict[str, Column]:
    """Keys in a file name: ``<host>_<instance>_<db>_<schema>.<table>.<ext>``, or without the database for a feed of
    ``instance_feeds``. The host may hold underscores; a name of another form has no keys."""
    feed = F.regexp_extract(name, r"_([^_.]+\.[^.]+)\.[A-Za-z0-9]+$", 1)
    per_instance = F.upper(feed).isin([f.upper() for f in instance_feeds]) if instance_feeds else F.lit(False)
    four, three = r"^(.+)_([^_]+)_([^_]+)_[^_.]+\.[^.]+\.[A-Za-z0-9]+$", r"^(.+)_([^_]+)_[^_.]+\.[^.]+\.[A-Za-z0-9]+$"

    def part(i: int) -> Column:
        return F.nullif(F.when(per_instance, F.regexp_extract(name, three, i)).otherwise(F.regexp_extract(name, four, i)), F.lit(""))

    whole = part(1).isNotNull()
    return {"host": part(1), "instance": part(2), "dbname": F.when(~per_instance, F.nullif(F.regexp_extract(name, four, 3), F.lit(""))),
            "feed": F.when(whole, F.upper(feed))}


def write_named(df: DataFrame, base: str, name: Column, ext: str = "parquet", fmt: str = "parquet", order: list[str] | None = None) -> int:
    """One file per name, ``<base>/<name>.<ext>`` (a name may hold folders): rows are written clustered by name beside the target, in
    the order of the columns ``order`` (which are left out), then each file is moved to its place (a file of that name is replaced). Rows of
    a name are one task. Returns the files written."""
    spark = df.sparkSession
    out = scratch_path(spark, "named")
    # the folder is a hash of the name, so any name can be one; the name itself is in a table of one row per file
    rows = df.withColumns({"_named": name, "_at": F.md5(name)})
    kept = [c for c in df.columns if c not in (order or [])]
    rows.select("_at", *df.columns).repartition("_at").sortWithinPartitions("_at", *(order or [])).select("_at", *kept).write.partitionBy("_at").format(fmt).save(out)
    names = {r[0]: r[1] for r in rows.select("_at", "_named").distinct().toLocalIterator()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(conf)
    fs.mkdirs(path(base))

    def move(row) -> int:
        to = path(path(base), f"{names[row['at']]}.{ext}")
        fs.mkdirs(to.getParent())
        if fs.exists(to):
            fs.delete(to, False)
        return int(fs.rename(path(row["path"]), to))

    files = list_files(spark, out, "part-*").select("path", F.regexp_extract("uri", "_at=([0-9a-f]+)/", 1).alias("at")).collect()
    with ThreadPoolExecutor(THREADS) as pool:
        return sum(pool.map(move, files))


def write_texts(df: DataFrame, base: str, name: str, value: str, order: list[str], ext: str) -> int:
    """One text file per value of the column ``name``, ``<base>/<name>.<ext>`` (a name may hold folders): its lines ``value`` in the
    order of ``order``. The tasks write the files under their names, each beside its place first, so many small files cost the driver
    nothing. A file of that name is replaced. Returns the files written. On storage that Python has no file system for, as
    ``write_named``."""
    from pyarrow import fs as pafs

    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    at = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    where = at.getPath() if at.getScheme() == "file" else at.toString()
    rows = df.select(F.col(name).alias("_named"), F.col(value).alias("value"), *order)
    try:
        pafs.FileSystem.from_uri(where)
    except (ValueError, OSError, NotImplementedError):
        return write_named(rows.select("value", "_named", *order), base, F.col("_named"), ext, "text", ["_named", *order])

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs as pafs

        store, root = pafs.FileSystem.from_uri(where)
        local, made, now, out, held, n = store.type_name == "local", set(), None, None, None, 0

        def close() -> None:
            out.close()
            to = f"{root}/{now}.{ext}"
            if local:  # a checksum of a file that Spark wrote there before
                folder, last = to.rsplit("/", 1)
                if store.get_file_info(f"{folder}/.{last}.crc").type != pafs.FileType.NotFound:
                    store.delete_file(f"{folder}/.{last}.crc")
            store.move(held, to)

        for batch in batches:
            for at, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != now:
                    if out is not None:
                        close()
                    folder = f"{root}/{at}".rsplit("/", 1)[0]
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    now, held, n = at, f"{folder}/.{uuid.uuid4().hex}.tmp", n + 1
                    out = store.open_output_stream(held)
                out.write(((line or "") + "\n").encode())
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    dealt = rows.repartition("_named").sortWithinPartitions("_named", *order).select("_named", "value")
    return dealt.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
