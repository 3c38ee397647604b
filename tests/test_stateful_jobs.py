"""Integrity rounds, dated event tables, stored statistics, manifests, rules by substring."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from opsward.operators import exports as ex
from opsward.operators import publish as pb
from opsward.operators import rounds as ir
from opsward.operators import sketches as sk
from opsward.operators.catalog import ordered_lists
from opsward.operators.dated import compact_index, upsert_dated
from opsward.operators.rules import resolve
from opsward.plans.registry import QUERIES, load_all
from opsward.session import scratch_path
from opsward.sources.listing import list_files
from opsward.streaming.ingest import ingest_dated


def plain_rounds(row_ok, refs):
    """Rows that cannot stay: a failing check, or a reference to a row that is not there or cannot stay."""
    gone = {k: "CHECK" for k, ok in row_ok.items() if not ok}
    while True:
        more = {r: "FK" for r, parents in refs.items() if r in row_ok and r not in gone and any(p not in row_ok or p in gone for p in parents)}
        if not more:
            return gone
        gone |= more


@pytest.fixture(scope="module")
def constraint_tables(spark):
    """60 tables in a chain with a cycle (T0 refers to T59 and T59 to T0), a self-reference, and 30 rows each."""
    rng = random.Random(1)
    ok = {(f"T{t}", i): rng.random() > 0.03 for t in range(60) for i in range(30)}
    refs = {}
    for t in range(1, 60):
        for i in range(30):
            refs.setdefault((f"T{t}", i), []).append((f"T{t - 1}", rng.randrange(31)))  # row 30 is missing
    for i in range(5):
        refs.setdefault(("T0", i), []).append(("T59", i))
    refs.setdefault(("T30", 1), []).append(("T30", 2))
    refs.setdefault(("T30", 2), []).append(("T30", 1))
    fks = {(c[0], p[0]) for c, ps in refs.items() for p in ps}
    return (ok, refs, spark.createDataFrame([(f"T{t}", t % 2 == 0) for t in range(60)], "tab string, pending boolean"),
            spark.createDataFrame(sorted(fks), "child string, parent string"),
            spark.createDataFrame([(*k, v) for k, v in ok.items()], "tab string, id long, ok boolean"),
            spark.createDataFrame([(*k, *p) for k, ps in refs.items() for p in ps], "tab string, id long, parent string, parent_id long"))


def test_rounds_until_clean_resume_after_a_lost_driver(spark, constraint_tables):
    ok, refs, tables, fks, row_facts, links = constraint_tables
    path = scratch_path(spark, "rounds-test")
    everything = tables.withColumn("pending", F.lit(True))
    ir.resolve_pending(spark, path, everything, fks, row_facts, links, per_round=20, most_rounds=2)
    # a round that did not get as far as its state is run again
    spark.createDataFrame([("T1", 99, "CHECK")], ir.EXCEPTIONS).write.parquet(f"{path}/round=2/exceptions")
    assert ir.last_round(spark, path) == 1
    state, gone = ir.resolve_pending(spark, path, everything, fks, row_facts, links, per_round=20)
    assert {(r.tab, r.id): r.reason for r in gone.collect()} == plain_rounds(ok, refs)
    assert state.where("pending").count() == 0 and state.where("not checked").count() == 0
    last = ir.last_round(spark, path)
    ir.resolve_pending(spark, path, everything, fks, row_facts, links, per_round=20)
    assert ir.last_round(spark, path) == last


def test_rounds_add_pending_parents_and_leave_other_tables(spark):
    tables = spark.createDataFrame([("A", True), ("B", True), ("C", False), ("D", True)], "tab string, pending boolean")
    fks = spark.createDataFrame([("A", "D"), ("B", "C")], "child string, parent string")
    row_facts = spark.createDataFrame([("A", 1, True), ("B", 1, None), ("C", 1, False), ("D", 1, True)], "tab string, id long, ok boolean")
    links = spark.createDataFrame([("A", 1, "D", 1), ("B", 1, "C", 1)], "tab string, id long, parent string, parent_id long")
    path = scratch_path(spark, "rounds-few")
    ir.resolve_pending(spark, path, tables, fks, row_facts, links, per_round=1, most_rounds=1)
    got = rows(spark.read.parquet(f"{path}/round=0/state").select("tab", "pending", "code", "action"))
    assert got == [("A", False, "SQL3600N", "check"), ("B", True, "", ""), ("C", False, "", ""), ("D", False, "SQL3608N", "add_parent")]
    state, gone = ir.resolve_pending(spark, path, tables, fks, row_facts, links, per_round=1)
    assert gone.count() == 0 and state.where("pending").count() == 0  # C was not pending, so nobody looked at its row


def _files(path):
    return {os.path.basename(d): sorted(f for f in fs if f.endswith(".parquet")) for d, _, fs in os.walk(path.removeprefix("file:")) if "part=" in d}


def test_reimported_events_touch_only_the_dates_they_lie_in(spark):
    path, index = scratch_path(spark, "dated-t"), scratch_path(spark, "dated-i")
    schema = "k int, s string, v string, seq int, part string"
    first = [(i, None if i % 7 == 0 else f"s{i % 3}", "old", 1, f"2024-01-{1 + i % 20:02d}") for i in range(400)]
    upsert_dated(spark, path, index, spark.createDataFrame(first, schema), ["k", "s"], "part", "seq")
    before = _files(path)
    second = [(3, "s0", "new", 2, "2024-02-01"), (7, None, "new", 2, "2024-01-09"), (7, None, "newer", 3, "2024-01-09"), (1000, "x", "fresh", 2, "2024-01-15"), (1001, "x", "fresh", 2, None)]
    counts = upsert_dated(spark, path, index, spark.createDataFrame(second, schema), ["k", "s"], "part", "seq")
    after = _files(path)
    changed = {d for d in set(before) | set(after) if before.get(d) != after.get(d)}
    assert changed == {"part=2024-01-04", "part=2024-01-08", "part=2024-02-01", "part=2024-01-09", "part=2024-01-15", "part=__HIVE_DEFAULT_PARTITION__"}
    assert set(before["part=2024-01-15"]) < set(after["part=2024-01-15"])  # appended to, not read
    assert (counts["dates_rewritten"], counts["dates_appended"]) == (2, 4)
    want = {(r[0], r[1]): (r[2], r[4]) for r in first} | {(3, "s0"): ("new", "2024-02-01"), (7, None): ("newer", "2024-01-09"), (1000, "x"): ("fresh", "2024-01-15"), (1001, "x"): ("fresh", None)}

    def table():
        got = spark.read.schema(schema).parquet(path).collect()
        assert len(got) == len({(r.k, r.s) for r in got})
        return {(r.k, r.s): (r.v, r.part) for r in got}

    assert table() == want
    upsert_dated(spark, path, index, spark.createDataFrame(second, schema), ["k", "s"], "part", "seq")  # run again after a crash
    assert table() == want
    small = scratch_path(spark, "dated-c")
    assert compact_index(spark, index, small) == len(want)
    # the last row of a date moves away: the folder goes
    upsert_dated(spark, path, small, spark.createDataFrame([(3, "s0", "gone on", 4, "2024-03-01")], schema), ["k", "s"], "part", "seq")
    assert "part=2024-02-01" not in _files(path) and table() == want | {(3, "s0"): ("gone on", "2024-03-01")}


def test_late_batches_never_move_a_key_back(spark):
    path, index = scratch_path(spark, "dated-late"), scratch_path(spark, "dated-late-i")
    schema = "k int, v string, seq int, part string"
    apply = lambda *r: upsert_dated(spark, path, index, spark.createDataFrame(list(r), schema), ["k"], "part", "seq", guard="newest")
    held = lambda at=path: rows(spark.read.schema(schema).parquet(at))
    apply((1, "a", 5, "d1"), (2, "b", 5, "d1"), (3, "c", 5, "d2"))
    before = _files(path)
    apply((1, "late", 4, "d0"), (4, "d", 1, "d0"))  # the row of key 1 stays in d1; d0 is new
    assert held() == [(1, "a", 5, "d1"), (2, "b", 5, "d1"), (3, "c", 5, "d2"), (4, "d", 1, "d0")]
    assert _files(path)["part=d2"] == before["part=d2"]
    small = scratch_path(spark, "dated-late-c")
    assert compact_index(spark, index, small) == 4
    index = small  # the last entry of key 1 is the date in which it lies
    apply((1, "new", 9, "d2"), (1, "newest", 10, "d3"))
    assert held() == [(1, "newest", 10, "d3"), (2, "b", 5, "d1"), (3, "c", 5, "d2"), (4, "d", 1, "d0")]
    with pytest.raises(ValueError):
        upsert_dated(spark, path, index, spark.createDataFrame([(1, "a", 5, "d1")], schema), ["k"], "part", None, guard="newest")


def test_stream_of_new_events_rewrites_no_date(spark):
    """Files as they come: those of new events only add, one that comes again touches the dates of its keys, a lost epoch is run again."""
    schema = "k int, v string, seq int, part string"
    drop, target, index, check = (scratch_path(spark, f"dated-stream-{x}") for x in ("drop", "target", "index", "check"))
    make = lambda r: spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(drop)
    run = lambda c=check: ingest_dated(spark, drop, spark.createDataFrame([], schema).schema, target, index, c, ["k"], "part", "seq", max_files_per_trigger=1)
    for d in range(3):
        make([(10 * d + i, "v", d, f"d{d}") for i in range(10)])
    assert [(c["dates_rewritten"], c["dates_appended"]) for c in run()] == [(0, 1)] * 3
    before = _files(target)
    make([(4, "again", 7, "d0"), (30, "v", 7, "d3")])
    assert [(c["dates_rewritten"], c["dates_appended"]) for c in run()] == [(1, 1)]
    after = _files(target)
    assert {d for d in after if after[d] != before.get(d)} == {"part=d0", "part=d3"}
    want = sorted([(10 * d + i, "again" if 10 * d + i == 4 else "v", 7 if 10 * d + i == 4 else d, f"d{d}") for d in range(3) for i in range(10)] + [(30, "v", 7, "d3")])
    assert rows(spark.read.schema(schema).parquet(target)) == want
    run(scratch_path(spark, "dated-stream-check-2"))  # all files once more, in any order
    assert rows(spark.read.schema(schema).parquet(target)) == want


def test_publishing_goes_on_after_a_failing_feed(spark):
    base = scratch_path(spark, "published")
    feeds = {"good": lambda: spark.range(5).withColumn("v", F.lit(None).cast("string")), "empty": lambda: spark.range(0),
             "gone": lambda: spark.read.parquet("/no/such/place"), "broken": lambda: spark.range(3).select(F.raise_error(F.lit("x")).alias("id"))}
    report = pb.publish_feeds(spark, feeds, base)
    got = {r.feed: (r.rows_moved, r.code) for r in report.collect()}
    assert got == {"good": (5, 0), "empty": (0, 0), "gone": (0, 1), "broken": (0, 1)}
    assert rows(pb.overall_code(report)) == [(4, 5, 2)]
    assert sorted(r.value for r in spark.read.text(f"{base}/good").collect()) == [f'{{"id":{i}}}' for i in range(5)]
    one = pb.publish_feeds(spark, feeds, scratch_path(spark, "published-one"), only=["good", "nothing"])
    assert rows(one) == [("good", 5, 0, None), ("nothing", 0, 1, "NO_SUCH_FEED")]
    assert rows(pb.overall_code(report.limit(0))) == [(0, 0, 0)]


def test_statistics_are_merged_and_read_new_partitions_only(spark):
    path, stats = scratch_path(spark, "sk-t"), scratch_path(spark, "sk-s")
    df = spark.range(40_000).selectExpr("cast(id % 9000 as int) a", "if(id % 10 = 0, null, id / 4d) b", "concat('w', id % 50) c", "concat('p', id % 8) part")
    df.where("part < 'p5'").write.partitionBy("part").parquet(path)
    columns = ["a", "b", "c"]
    read = lambda: spark.read.schema(df.schema).parquet(path)
    assert sk.update_statistics(spark, read(), "part", columns, stats) == 5
    df.where("part >= 'p5'").write.mode("append").partitionBy("part").parquet(path)
    assert sk.update_statistics(spark, read(), "part", columns, stats) == 3
    assert sk.update_statistics(spark, read(), "part", columns, stats) == 0
    kept = spark.read.schema(sk.STATS).parquet(stats)
    assert kept.count() == 24
    got = {r["column"]: r for r in sk.profile(kept).collect()}
    assert (got["a"].n, got["a"].n_null, got["a"].least, got["a"].greatest, got["a"].n_parts) == (40_000, 0, 0, 8999, 8)
    assert (got["b"].n_null, got["b"].least, got["b"].greatest) == (4000, 0.25, 9999.75)
    assert (got["c"].least_text, got["c"].greatest_text, got["c"].q50) == ("w0", "w9", None)
    assert abs(got["a"].n_distinct - 9000) <= 0.05 * 9000 and got["c"].n_distinct == 50 and abs(got["b"].n_distinct - 36_000) <= 0.05 * 36_000
    for q, x in ((0.25, got["b"].q25), (0.5, got["b"].q50), (0.75, got["b"].q75)):
        assert abs(x / 10_000 - q) <= 0.03
    sampled = scratch_path(spark, "sk-f")
    sk.update_statistics(spark, read(), "part", columns, sampled, fraction=0.1)
    some = {r["column"]: r for r in sk.profile(spark.read.schema(sk.STATS).parquet(sampled)).collect()}
    assert abs(some["a"].n - 40_000) <= 2 * some["a"].n_bound and 0 < some["a"].n_bound < 2000 and got["a"].n_bound == 0


def test_manifest_tells_changed_files(spark):
    path = scratch_path(spark, "mf")
    df = spark.range(100).selectExpr("id", "if(id % 10 = 0, null, concat('h', id % 3)) host", "id % 2 db")
    got = ex.export_with_manifest(df, path, ["host", "db"])
    assert rows(got.groupBy("host").agg(F.sum("n_rows"))) == rows(df.groupBy("host").agg(F.count(F.lit(1))))
    assert spark.read.parquet(path).count() == 100 and ex.check_manifest(spark, path, ["host", "db"]).count() == 0
    df.where("id < 3").write.mode("append").partitionBy("host", "db").parquet(path)
    assert rows(ex.check_manifest(spark, path, ["host", "db"])) == [("h1", 1, 17, 18), ("h2", 0, 14, 15), (None, 0, 10, 11)]


def test_old_files_go_and_a_dry_run_keeps_them(spark, tmp_path):
    now = 1_700_000_000
    for i in range(6):
        f = tmp_path / ("sub dir" if i % 2 else "a%20b") / f"file {i}.log"
        f.parent.mkdir(exist_ok=True)
        f.write_text("x" * i)
        os.utime(f, (now - 86_400 * i, now - 86_400 * i))
    as_of = F.timestamp_seconds(F.lit(now + 60))
    want = [(f"file {i}.log", i, i) for i in (3, 4, 5)]
    seen = rows(ex.purge_files(spark, str(tmp_path), as_of, 3, "*.log"))
    assert [(n.replace("%20", " "), b, a) for n, b, a in seen] == want and list_files(spark, str(tmp_path)).count() == 6
    assert len(rows(ex.purge_files(spark, str(tmp_path), as_of, 3, "*.log", dry_run=False))) == 3
    assert sorted(f.name for f in tmp_path.rglob("*.log")) == ["file 0.log", "file 1.log", "file 2.log"]


def test_rules_that_contain_names(spark):
    ent = spark.createDataFrame([(1, "srv1", "db2a", "SALES"), (2, "SRV2", "db2a", "HR"), (3, "srv12", "db2b", "SALES"), (4, "other", "i", "D"), (5, "srv1", "db2a", None), (6, "", "x", "Y")],
                                "id int, host string, instance string, dbname string")
    rules = spark.createDataFrame([(1, "*", "*", "*", 10), (2, "srv1,srv2", "*", "*", 20), (3, "srv12", "*", "*", 30), (4, "srv1,srv2", "db2a db2c", "sales+hr", 40), (5, "zzz", "*", "*", 50), (6, "*", "db2a", "*", 60)],
                                  "line_no int, host string, instance string, dbname string, v int")
    got = {r.id: (r.line_no, r.v) for r in resolve(ent, rules, ["id"], ["v"], match="contains").collect()}
    # "srv12" contains "srv1", so its later line wins for srv1 among rules of hosts; the database shape is more specific
    assert got == {1: (4, 40), 2: (4, 40), 3: (3, 30), 4: (1, 10), 5: (3, 30), 6: (1, 10)}
    exact = {r.id: r.v for r in resolve(ent, rules, ["id"], ["v"]).collect()}
    assert exact == {1: 10, 2: 10, 3: 30, 4: 10, 5: 10, 6: 10}
    with pytest.raises(ValueError):
        resolve(ent, rules, ["id"], ["v"], match="like")


def test_contains_work_grows_with_the_lines(spark):
    """A line is cut into pieces, never met with every name."""
    ent = spark.range(3000).selectExpr("id", "concat('host', id) host", "'i' instance", "'d' dbname")
    rules = spark.range(2000).selectExpr("cast(id as int) line_no", "concat('host', id) host", "'*' instance", "'*' dbname", "id v")
    out = resolve(ent, rules, ["id"], ["v"], match="contains")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {r.id: r.v for r in out.collect()}
    assert all(got[i] == max(v for v in range(2000) if f"host{i}" in f"host{v}") for i in (1, 17, 199, 1999)) and got[2500] is None


def test_phases_go_on_after_failures_and_a_lost_driver(spark):
    from opsward.operators import phases as ph
    tables = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "c")], "schema string, tab string")
    work = ph.plan(tables, ["stats", "reorg", "stats"], ["rebind"])
    path = scratch_path(spark, "journal-t")
    seen = []

    def act(name, bad=()):
        def run(todo):
            seen.append((name, sorted((r.schema, r.tab or "") for r in todo.collect())))
            return todo.select("schema", "tab", (~F.coalesce("tab", F.lit("")).isin(*bad, "-")).alias("ok"), F.lit(1).alias("n"))
        return run

    def dies(todo):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ph.run_plan(spark, path, work, {"stats": act("stats"), "reorg": dies, "rebind": act("rebind")})
    assert ph.run_plan(spark, path, work, {"stats": act("stats"), "reorg": act("reorg", ["a"]), "rebind": act("rebind")}) == 3
    assert ph.run_plan(spark, path, work, {"stats": act("stats"), "reorg": act("reorg"), "rebind": act("rebind")}) == 0
    assert ph.run_plan(spark, path, work, {}) == 0
    every = [("s1", "a"), ("s1", "b"), ("s2", "c")]
    assert seen == [("stats", every), ("reorg", every), ("stats", every[1:]), ("rebind", [("s2", "")]),
                    ("reorg", every[:1]), ("stats", every[:1]), ("rebind", [("s1", "")])]


def test_listed_slices_prune_the_scan(spark):
    from opsward.sources.files import scan_slices
    path, listed = scratch_path(spark, "sl-t"), scratch_path(spark, "sl-l")
    df = spark.range(500).selectExpr("id", "concat('h', id % 5) host", "concat('d', id % 7) day")
    df.write.partitionBy("host", "day").parquet(path)
    spark.createDataFrame([("h1", "d1"), ("h2", "d6"), ("h9", "d1"), ("h1", "d1")], "host string, day string").write.parquet(listed)
    out = scan_slices(spark, path, spark.read.parquet(listed), ["host", "day"])
    assert "dynamicpruning" in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert rows(out.select("id")) == rows(df.where("host = 'h1' and day = 'd1' or host = 'h2' and day = 'd6'").select("id"))


def test_object_files_and_sorted_manifest(spark, tmp_path):
    from opsward.operators import corpus as cp
    from opsward.sources.text import script_lines
    data = [("f", i + 1, s) for i, s in enumerate(['CREATE TABLE "S1"."T1" (', "  A INT );", "CREATE VIEW V1 AS", "SELECT 1;", 'CREATE TABLE "S2"."T1" (', "B INT );"])]
    lines = spark.createDataFrame(data, "file string, line_no int, line string")
    assert cp.write_object_files(lines, str(tmp_path / "o")) == 3
    got = {str(p.relative_to(tmp_path / "o")): p.read_text() for p in (tmp_path / "o").rglob("*.ddl")}
    assert got == {"TABLE/S1/T1.ddl": 'CREATE TABLE "S1"."T1" (\n  A INT );\n', "VIEW/UNQUAL/V1.ddl": "CREATE VIEW V1 AS\nSELECT 1;\n",
                   "TABLE/S2/T1.ddl": 'CREATE TABLE "S2"."T1" (\nB INT );\n'}
    df = spark.range(5000).selectExpr("id % 7 a", "id b")
    path = cp.write_sorted(df, str(tmp_path / "m"), ["a", "b"], F.concat_ws(",", "a", "b"))
    back = cp.read_sorted(script_lines(spark, path, "part-*")).collect()
    assert [r.line for r in sorted(back)] == [f"{a},{b}" for a, b in sorted((i % 7, i) for i in range(5000))]
    assert sorted(r.line_no for r in back) == list(range(1, 5001))


def test_last_file_of_a_batch_wins_however_files_are_packed(spark, tmp_path):
    """Spark packs large files first; the order of a load is that of the names."""
    from opsward.operators.upsert import upsert_into_path
    from opsward.sources.listing import write_named
    drop = str(tmp_path / "drop")
    for name, n in (("b_first", 20_000), ("c_last", 10), ("a_zero", 500)):
        write_named(spark.range(n).selectExpr("cast(id % 10 as int) k", f"'{name}' v", "rand() pad"), drop, F.lit(name))
    read = spark.read.parquet(drop).select("k", "v")
    path, dated, index = str(tmp_path / "t"), str(tmp_path / "d"), str(tmp_path / "i")
    upsert_into_path(spark, path, read.withColumn("part", F.lit(1)), ["k"], None, ["part"])
    assert rows(spark.read.parquet(path).select("k", "v")) == [(k, "c_last") for k in range(10)]
    upsert_dated(spark, dated, index, read.withColumn("part", F.substring("v", 1, 1)), ["k"], "part", None)
    assert rows(spark.read.parquet(dated).select("k", "v")) == [(k, "c_last") for k in range(10)]


def test_lists_of_more_names_than_a_row_holds(spark):
    names = [("A", f"t{i:05d}") for i in range(2500)] + [("B", "only")] + [("C", f"t{i:04d}") for i in range(1000)]
    random.Random(2).shuffle(names)
    got = ordered_lists(spark, spark.createDataFrame(names, "s string, t string").repartition(7), ["s"], "t", 1000)
    got = {(r.s, r.chunk): (r.item_list.split(","), r.n_items) for r in got.collect()}
    assert {k: n for k, (_, n) in got.items()} == {("A", 0): 1000, ("A", 1): 1000, ("A", 2): 500, ("B", 0): 1, ("C", 0): 1000}
    assert [x for i in range(3) for x in got["A", i][0]] == [f"t{i:05d}" for i in range(2500)]


def test_state_lines(spark):
    """A line of each service and state, written by hand."""
    load_all()
    lines = {(r.service, r.status_code): r.line for r in QUERIES["state_lines"](spark, SF_SMALL).collect()}
    assert all(line.startswith(f"{code} {service}_") and f"={code};" in line for (service, code), line in lines.items())
    texts = {("Activation_status", 0): "OK - ", ("Quiesce_status", 0): "OK - ", ("Quiesce_status", 1): "WARNING - ", ("Quiesce_status", 2): "CRITICAL - ", ("Quiesce_status", 3): "UNKNOWN - "}
    for key, text in texts.items():
        assert key in lines and text in lines[key]
    line = lines["Quiesce_status", 2]
    db = line.split()[1].rsplit("_", 1)[1]
    assert line.endswith(f" quiesce_status=2;1;2 CRITICAL - {db} is QUIESCEd.")
