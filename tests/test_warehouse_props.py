"""Properties: upsert idempotence, NULL-safe matching, stream = batch, compaction keeps the multiset."""

import datetime as dt

from pyspark.sql import functions as F

from opsward.operators.catalog import compact, split_in_chunks
from opsward.operators.upsert import dedupe_latest, merge_last_seen, upsert, upsert_into_path
from opsward.session import scratch_path
from opsward.streaming.ingest import ingest_drop_folder

from conftest import SF_SMALL, rows


def _ev(spark):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet")


def test_upsert_idempotent_and_source_wins(spark):
    ev = _ev(spark)
    keys = ["user_id", "event_type"]
    t = dedupe_latest(ev.where("ts < '2024-01-20'"), keys, "event_id")
    s = ev.where("ts >= '2024-01-15'")
    once = upsert(t, s, keys, "event_id")
    twice = upsert(once, s, keys, "event_id")
    assert rows(once) == rows(twice)
    assert once.count() == once.select(*keys).distinct().count()


def test_upsert_null_keys_match(spark):
    t = spark.createDataFrame([(None, "a", 1), (1, "b", 1)], "k int, x string, seq int")
    s = spark.createDataFrame([(None, "c", 2)], "k int, x string, seq int")
    assert sorted(rows(upsert(t, s, ["k"], "seq")), key=str) == sorted([(1, "b", 1), (None, "c", 2)], key=str)


def test_merge_last_seen_only_moves_stamp(spark):
    t = spark.createDataFrame([(1, None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))], "k int, n string, f timestamp_ntz, l timestamp_ntz")
    s = spark.createDataFrame([(1, None, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9)),
                               (2, "x", dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 7))], "k int, n string, f timestamp_ntz, l timestamp_ntz")
    got = sorted(rows(merge_last_seen(t, s, ["k", "n"], "l")), key=str)
    assert got == sorted([(1, None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9)),
                          (2, "x", dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 7))], key=str)


def test_stream_equals_batch(spark):
    ev = _ev(spark)
    keys = ["user_id", "event_type"]
    drop = scratch_path(spark, "t-drop")
    ev.repartition(4).write.parquet(drop)
    target = scratch_path(spark, "t-target")
    ingest_drop_folder(spark, drop, ev.schema, target, scratch_path(spark, "t-ckpt"), keys, "event_id", ["event_type"],
                       max_files_per_trigger=1)
    batch = dedupe_latest(ev, keys, "event_id")
    assert rows(spark.read.parquet(target).select(*ev.columns)) == rows(batch.select(*ev.columns))


def test_upsert_into_path_touches_only_batch_partitions(spark):
    ev = _ev(spark)
    keys = ["user_id", "event_type"]
    path = scratch_path(spark, "t-wh")
    dedupe_latest(ev, keys, "event_id").write.partitionBy("event_type").parquet(path)
    before = rows(spark.read.parquet(path).where("event_type <> 'click'").select("event_id"))
    newer = ev.where("event_type = 'click'").withColumn("event_id", F.col("event_id") + 10_000_000)
    m = upsert_into_path(spark, path, newer, keys, "event_id", ["event_type"])
    assert m["rows_written"] == m["rows_from_batch"] > 0
    after = spark.read.parquet(path)
    assert rows(after.where("event_type <> 'click'").select("event_id")) == before
    assert after.where("event_type = 'click'").agg(F.min("event_id")).first()[0] >= 10_000_000


def test_compaction_preserves_rows(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    out = compact(li, scratch_path(spark, "t-compact"), ["l_shipdate", "l_orderkey"], 4)
    assert rows(spark.read.parquet(out)) == rows(li)


def test_split_in_chunks_numbers_densely(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("k"))
    out = split_in_chunks(spark, df, ["k"], 4, n_ranges=5).collect()
    rn = sorted(r.rn for r in out)
    assert rn == list(range(1, 1001))
    size = 1000 // 4 + 10
    assert all(r.chunk == (r.rn - 1) // size for r in out)
    assert all(r.rn == r.k + 1 for r in out)


def test_ordered_lists_chunked(spark):
    from opsward.operators.catalog import ordered_lists
    data = [("a", f"t{i:03d}") for i in range(25)] + [("b", "x"), ("b", "w")]
    df = spark.createDataFrame(data, "g string, name string")
    got = rows(ordered_lists(spark, df, ["g"], "name", 10).select("g", "chunk", "item_list", "n_items"))
    assert got == [("a", 0, ",".join(f"t{i:03d}" for i in range(10)), 10),
                   ("a", 1, ",".join(f"t{i:03d}" for i in range(10, 20)), 10),
                   ("a", 2, ",".join(f"t{i:03d}" for i in range(20, 25)), 5),
                   ("b", 0, "w,x", 2)]


def test_feed_registry_last_seen_and_upsert(spark):
    import datetime as _dt
    from opsward.sources.feeds import FEEDS, load_batch, scan_slice, stamp
    conn = FEEDS["connection_info"]
    cols = [k for k in conn.keys if k not in ("hostname", "instancename", "dbname")]
    live1 = spark.createDataFrame([tuple(["a"] + [None] * (len(cols) - 1))], ", ".join(f"{c} string" for c in cols))
    path = scratch_path(spark, "t-conn")
    b1 = stamp(live1, conn, "h1", "INST1", "db1", _dt.datetime(2024, 1, 1))
    load_batch(spark, conn, path, b1)
    b2 = stamp(live1, conn, "h1", "INST1", "db1", _dt.datetime(2024, 1, 5))
    load_batch(spark, conn, path, b2)
    back = spark.read.parquet(path)
    assert back.count() == 1
    assert back.first()["capture_timestamp"] == _dt.datetime(2024, 1, 5)
    assert back.first()["instancename"] == "inst1" and back.first()["dbname"] == "DB1"

    tbl = FEEDS["table_cumul"]
    rows1 = spark.createDataFrame([("T1", "S", 0, 10), ("T2", "S", 0, 20)], "tabname string, tabschema string, member int, rows_read long")
    p2 = scratch_path(spark, "t-tbl")
    load_batch(spark, tbl, p2, stamp(rows1, tbl, "h1", "i1", "db1", _dt.datetime(2024, 1, 1)))
    again = load_batch(spark, tbl, p2, stamp(rows1, tbl, "h1", "i1", "db1", _dt.datetime(2024, 1, 1)))
    assert again["rows_written"] == 2
    assert scan_slice(spark.read.parquet(p2), tbl, hostname="h1", dbname="db1").count() == 2
