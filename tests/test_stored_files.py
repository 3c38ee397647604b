"""Scripts by byte range, file listings and names, the load ledger, and purges of odd partitions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from opsward.functions.time import lit_ts
from opsward.operators import corpus as cp
from opsward.operators import ledger as lg
from opsward.operators import retention as rt
from opsward.session import scratch_path
from opsward.sources.listing import list_files, name_keys, write_named
from opsward.sources.text import script_lines, write_scripts


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_of_files_larger_than_a_split(spark, small_splits, tmp_path):
    rng = random.Random(4)
    texts = {
        "long.sql": "".join(f"line {i} " + "x" * rng.randrange(90) + rng.choice(["\n", "\r\n"]) for i in range(3000)),
        "no_end.sql": "a\n\n\nb", "empty.sql": "", "one.sql": "\n", "wide.sql": "start\n" + "y" * 30_000 + "\nend\n", "cr.sql": "a\rb\nc\n"}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    lines = script_lines(spark, str(tmp_path))
    assert spark.read.option("lineSep", "\n").text(str(tmp_path / "long.sql")).rdd.getNumPartitions() > 20
    got = {}
    for r in lines.collect():
        got.setdefault(os.path.basename(r.file), {})[r.line_no] = r.line
    for name, t in texts.items():
        want = t.split("\n")[:-1] if t.endswith("\n") else t.split("\n") if t else []
        assert got.get(name, {}) == {i + 1: x.removesuffix("\r") for i, x in enumerate(want)}, name


def test_blocks_of_one_large_script(spark, small_splits):
    data = [("big", 10 * i + j, s) for i in range(600) for j, s in enumerate([f'CREATE TABLE "S"."T{i}" (', "  a INT ,", "-- note", "  b INT );", "GRANT x;"])]
    path = write_scripts(spark.createDataFrame(data, "file string, line_no int, line string"), scratch_path(spark, "one-script"))
    got = rows(cp.extract_blocks(script_lines(spark, path), chunk_lines=64).select("name", "begin_line", "n_lines"))
    assert got == sorted((f"T{i}", 5 * i + 1, 3) for i in range(600))


def test_name_keys(spark):
    names = ["h1_db2_SALES_ABSDBA.GET_PKG_CACHE_STMT.ixf", "my_host_i_DB_A.B.del", "my_host_i_SYSIBMADM.DBMCFG.ixf", "h_i_SYSIBMADM.DBMCFG.ixf",
             "h_i_A.B.ixf", "notes.txt", "h_i_db_table.ixf"]
    d = spark.createDataFrame([(n,) for n in names], "name string")
    got = d.withColumns(name_keys(F.col("name"), ["sysibmadm.dbmcfg"])).select("host", "instance", "dbname", "feed").collect()
    assert [tuple(r) for r in got] == [
        ("h1", "db2", "SALES", "ABSDBA.GET_PKG_CACHE_STMT"), ("my_host", "i", "DB", "A.B"), ("my_host", "i", None, "SYSIBMADM.DBMCFG"),
        ("h", "i", None, "SYSIBMADM.DBMCFG"), (None,) * 4, (None,) * 4, (None,) * 4]


def test_files_named_by_key(spark):
    base = scratch_path(spark, "named-test")
    assert list_files(spark, base).count() == 0
    df = spark.createDataFrame([(i, f"h{i % 3}_i_D_S.T x") for i in range(30)], "k int, n string")
    assert write_named(df, base, F.col("n")) == 3
    assert write_named(df.where("k < 3"), base, F.col("n")) == 3
    assert sorted(r.name for r in list_files(spark, base).collect()) == ["h0_i_D_S.T%20x.parquet", "h1_i_D_S.T%20x.parquet", "h2_i_D_S.T%20x.parquet"] or \
        sorted(r.name for r in list_files(spark, base).collect()) == ["h0_i_D_S.T x.parquet", "h1_i_D_S.T x.parquet", "h2_i_D_S.T x.parquet"]
    assert rows(spark.read.parquet(base).select("k")) == [(0,), (1,), (2,)]


def _load(spark, base, at, target, rejects, **kw):
    return lg.load_pending(spark, base, at, target, rejects, "k long, v double", ["k"], ["S.I"], **kw)


def test_ledger_takes_each_file_once_and_resumes(spark):
    base, at, target, rejects = (scratch_path(spark, x) for x in ("l-drop", "l-ledger", "l-rows", "l-rejects"))
    assert _load(spark, base, at, target, rejects).count() == 0
    df = spark.createDataFrame([(i if i % 5 else None, float(i), f"h_i_D{i % 2}_S.T") for i in range(20)], "k long, v double, n string")
    write_named(df, base, F.col("n"))
    write_named(spark.createDataFrame([], "k long, v double").unionByName(spark.range(0).selectExpr("id k", "0d v")).withColumn("n", F.lit("x")), base, F.col("n"))
    first = list_files(spark, base).first().path
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(jvm.org.apache.hadoop.fs.Path(base, "h_i_S.I.parquet"), True)
    out.write(bytearray(b"PAR1 nothing else"))
    out.close()
    lines = _load(spark, base, at, target, rejects)
    assert rows(lines.select("name", "state", "n_rows", "n_rejects")) == [
        ("h_i_D0_S.T.parquet", "done", 8, 2), ("h_i_D1_S.T.parquet", "done", 8, 2), ("h_i_S.I.parquet", "failed", 0, 0)]
    assert rows(lg.progress_lines(lines).select("line")) == [
        ("S.I - h_i_S.I.parquet (1/1) failed: the file cannot be read",), ("S.T - h_i_D0_S.T.parquet (1/2) 8 rows, 2 rejected",),
        ("S.T - h_i_D1_S.T.parquet (2/2) 8 rows, 2 rejected",)]
    assert spark.read.parquet(target).count() == 16 and spark.read.parquet(rejects).count() == 4
    assert rows(_load(spark, base, at, target, rejects).select("name", "state")) == [("h_i_S.I.parquet", "failed")]
    # a run that died after it wrote rows: its folder goes, its files come again, nothing is there twice
    spark.range(3).selectExpr("id k", "1d v", "'h' host", "'i' instance", "'D' dbname", "'S.T' feed").write.parquet(f"{target}/batch=dead")
    died = lg.latest_state(lg.read_ledger(spark, at)).where(F.col("path") == first)
    died.withColumns({"state": F.lit("loading"), "batch": F.lit("dead"), "at": F.current_timestamp(), "bytes": F.lit(1).cast("long")}).select(*lg.LEDGER.names).write.mode("append").parquet(at)
    _load(spark, base, at, target, rejects)
    assert spark.read.parquet(target).where("batch = 'dead'").count() == 0
    state = rows(lg.latest_state(lg.read_ledger(spark, at)).select("name", "state"))
    assert state == [("h_i_D0_S.T.parquet", "done"), ("h_i_D1_S.T.parquet", "done"), ("h_i_S.I.parquet", "failed")]


def test_purge_of_null_and_escaped_partitions_over_two_levels(spark):
    old, new = "2024-01-01 00:00:00", "2024-01-09 00:00:00"
    o = spark.createDataFrame([(1, old, "2024-01-01"), (2, new, "2024-01-09"), (3, old, None), (4, new, None)], "o int, t string, part string").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    li = spark.createDataFrame([(1, 10, "a:1"), (1, 11, None), (2, 20, None), (2, 21, "b/ %=2"), (3, 30, "only old#"), (None, 40, None)], "o int, l int, part string")
    sh = spark.createDataFrame([(10, "x", "p=1"), (11, "x", None), (20, "y", None), (30, "z", "{q}")], "l int, s string, part string")
    paths = [scratch_path(spark, x) for x in ("p-o", "p-l", "p-s")]
    for df, p in zip((o, li, sh), paths):
        df.repartition(1).write.partitionBy("part").parquet(p)
    counts = rt.apply_purge(spark, paths[0], "ts", lit_ts("2024-01-10 00:00:00"), 5, "part",
                            children=[(paths[1], "o", "o", ["part"], [(paths[2], "l", "l", ["part"])])])
    assert [counts[p] for p in paths] == [2, 3, 3]
    assert rows(spark.read.parquet(paths[0]).select("o")) == [(2,), (4,)]
    assert rows(spark.read.parquet(paths[1]).select("o", "l")) == [(2, 20), (2, 21), (None, 40)]
    assert rows(spark.read.parquet(paths[2]).select("l", "s")) == [(20, "y")]
    assert [x for x in os.listdir(paths[2].removeprefix("file:")) if x.startswith("part=")] == ["part=__HIVE_DEFAULT_PARTITION__"]
    again = rt.apply_purge(spark, paths[0], "ts", lit_ts("2024-01-10 00:00:00"), 5, "part", children=[(paths[1], "o", "o", ["part"])])
    assert set(again.values()) == {0}
