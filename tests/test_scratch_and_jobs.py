"""Scratch ownership, inner jobs of writing operators, feeds, versions and the applied purge on literal inputs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import opsward.session as session
from opsward.functions.time import lit_ts
from opsward.operators import logs as lg
from opsward.operators import retention as rt
from opsward.operators.upsert import dedupe_latest, merge_last_seen, upsert_into_path
from opsward.plans.logs import parsed_window
from opsward.sources.feeds import FEEDS, Feed, load_batch

from conftest import SF_SMALL, rows


def test_shared_folder_is_required_off_local(spark, monkeypatch):
    class Bare:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Bare()

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())


def test_scratch_is_removed_by_its_owner(spark):
    path = session.scratch_path(spark, "owned")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file://")
    assert os.path.isdir(local)
    assert session.clean_scratch(spark) >= 1 and not os.path.exists(local)


def test_log_report_reads_the_log_once(spark):
    df = lg.report(spark, parsed_window(spark, SF_SMALL), "x")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "PartitionFilters: [isnotnull(day" in plan
    assert df.where("section_no = 9").count() == 2


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_reads_and_writes_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 10).alias("b"), F.lit(0).alias("v")).write.partitionBy("b").parquet(path)
    before = files_of(path)
    batch = spark.createDataFrame([(3, 3, 1), (103, 3, 1)], "id long, b long, v int")
    assert upsert_into_path(spark, path, batch, ["id"], None, ["b"]) == {"rows_written": 11, "rows_from_batch": 2}
    after = files_of(path)
    assert {f for f in before if before[f] != after.get(f)} == {f for f in before if "/b=3/" in f}
    assert spark.read.parquet(path).count() == 101


def test_upsert_edge_rows(spark, tmp_path):
    t = spark.createDataFrame([(1, None, 1)], "k int, p string, v int")
    path = str(tmp_path / "t")
    upsert_into_path(spark, path, t, ["k"], None, ["p"])
    upsert_into_path(spark, path, spark.createDataFrame([(3, None, 3), (3, None, 4)], t.schema), ["k"], None, ["p"])
    assert rows(spark.read.schema(t.schema).parquet(path).select("k", "v")) == [(1, 1), (3, 4)]
    one = dedupe_latest(spark.createDataFrame([(1, None, "a")], "k int, seq int, v string"), ["k"], "seq")
    assert rows(one) == [(1, None, "a")]


def test_last_seen_keeps_nulls_of_a_match(spark):
    old = spark.createDataFrame([(1, None, 5), (2, "x", 5)], "k int, v string, seen int")
    new = spark.createDataFrame([(1, "new", 9), (3, "y", 1), (2, "z", 4)], old.schema)
    assert rows(merge_last_seen(old, new, ["k"], "seen")) == [(1, None, 9), (2, "x", 4), (3, "y", 1)]


def test_feeds_partition_by_what_their_keys_fix(spark, tmp_path):
    for feed in FEEDS.values():
        fixed = set(feed.keys) | ({"capture_date"} if feed.time_col in feed.keys else set())
        assert set(feed.partition_cols) <= fixed, feed.name
    with pytest.raises(ValueError):
        load_batch(spark, Feed("bad", ("id",)), str(tmp_path / "x"), spark.range(1).withColumn("capture_timestamp", lit_ts("2024-01-01 00:00:00")))


def test_versions_of_two_and_more_digits(spark):
    have = spark.createDataFrame([("20240101_99",), ("20240102_128",), ("20240103_00",)], "folder string")
    days = spark.createDataFrame([("20240103",), ("20240104",)], "day string")
    assert rows(rt.next_version(have, days=days)) == [("20240101", "20240101_100"), ("20240102", "20240102_129"), ("20240103", "20240103_01"), ("20240104", "20240104_00")]


def test_purge_is_applied_children_first(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    orders = spark.createDataFrame([(1, day(1)), (2, day(2)), (3, day(9)), (4, None)], "o int, ts timestamp_ntz").withColumn("part", F.to_date("ts").cast("string"))
    lines = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (3, 1, 1), (9, 1, 2)], "o int, ln int, part int")
    op, lp = str(tmp_path / "o"), str(tmp_path / "l")
    orders.write.partitionBy("part").parquet(op)
    lines.write.partitionBy("part").parquet(lp)
    before = files_of(lp)
    counts = rt.apply_purge(spark, op, "ts", lit_ts("2024-01-10 00:00:00"), 5, "part", children=[(lp, "o", "o", ["part"])])
    assert counts == {op: 2, lp: 2}
    assert rows(spark.read.parquet(op).select("o")) == [(3,), (4,)] and rows(spark.read.parquet(lp).select("o", "ln")) == [(3, 1), (9, 1)]
    assert not os.path.exists(f"{op}/part=2024-01-01") and not os.path.exists(f"{lp}/part=0")
    assert [f for f in before if "/part=2/" in f] == [f for f in files_of(lp) if "/part=2/" in f]
