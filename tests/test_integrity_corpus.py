"""FIXTURES 3.5-3.8: constraint graph, messages, script blocks, SQL references; divert properties."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from opsward.functions import messages as msg
from opsward.functions.time import lit_ts
from opsward.operators import corpus as cp
from opsward.operators import integrity as ig

from conftest import rows

EDGES = [("lineitem", "orders"), ("orders", "customer"), ("customer", "nation"), ("nation", "region"), ("lineitem", "part")]


def test_fk_closure_fixture(spark):
    edges = spark.createDataFrame(EDGES, "child string, parent string")
    start = spark.createDataFrame([("lineitem",)], "name string")
    got = rows(ig.closure(spark, start, edges))
    assert got == [("customer", 2), ("lineitem", 0), ("nation", 3), ("orders", 1), ("part", 1), ("region", 4)]


def test_pending_set_fixture(spark):
    refs = spark.createDataFrame([("S", c, "S", p) for c, p in EDGES], "tabschema string, tabname string, reftabschema string, reftabname string")
    names = ["lineitem", "orders", "customer", "nation", "region", "part"]

    def cat(flagged):
        return spark.createDataFrame([("S", n, n in flagged) for n in names], "tabschema string, tabname string, pending boolean")
    assert rows(ig.pending_set(cat({"orders"}), refs)) == [("S", "orders")]
    assert rows(ig.pending_set(cat({"orders", "customer"}), refs)) == [("S", "customer"), ("S", "orders")]


def test_validate_and_divert_partition_the_input(spark):
    child = spark.createDataFrame([(1, 1, 5.0), (1, 1, 60.0), (2, 1, 3.0), (3, 1, None), (None, 2, 1.0)],
                                  "k long, ln int, q double")
    parent = spark.createDataFrame([(1,), (3,)], "pk long")
    tagged = ig.tag_violations(child, fk=[("fk", parent, ["k"], ["pk"])], unique=[("uq", ["k", "ln"])],
                               checks=[("ck", F.col("q") <= 50)])
    good, exc = ig.divert(tagged, lit_ts(dt.datetime(2024, 1, 31)))
    assert sorted(rows(good, "k", "ln", "q") + rows(exc, "k", "ln", "q"), key=str) == sorted(rows(child), key=str)
    assert good.count() + exc.count() == child.count()
    info = {(r.k, r.q): r.n2_info for r in exc.collect()}
    assert info == {(1, 5.0): "uq", (1, 60.0): "ck,uq", (2, 3.0): "fk"}
    # NULL key passes the FK, NULL value passes the check
    assert (None, 2, 1.0) in rows(good, "k", "ln", "q") and (3, 1, None) in rows(good, "k", "ln", "q")


def test_divert_cascade(spark):
    cust = spark.createDataFrame([(1, -5.0), (2, 10.0)], "c long, bal double")
    orders = spark.createDataFrame([(10, 1), (11, 2)], "o long, c long")
    lines = spark.createDataFrame([(10, 1), (10, 2), (11, 1)], "o long, ln int")
    d = ig.divert_cascade({"c": cust, "o": orders, "l": lines}, ["c", "o", "l"],
                          [("o", ["c"], "c", ["c"]), ("l", ["o"], "o", ["o"])], {"c": F.col("bal") >= 0})
    assert rows(d["c"].select("c")) == [(1,)]
    assert rows(d["o"].select("o")) == [(10,)]
    assert rows(d["l"].select("o", "ln")) == [(10, 1), (10, 2)]


def test_resolve_prefix(spark):
    cat = spark.createDataFrame([("S", "ABCDEFGH_1"), ("S", "ABCDEFGH_2"), ("S", "ABCDEFXY"), ("T", "ABCDEFGH_9")],
                                "s string, n string")
    trunc = spark.createDataFrame([("S", "ABCDEFGH"), ("S", "ABCDEFXY"), ("S", "ZZ")], "s string, t string")
    got = rows(ig.resolve_prefix(trunc, cat, "s", "n", "t"))
    assert got == [("S", "ABCDEFGH", 2, "ambiguous", None), ("S", "ABCDEFXY", 1, "unique", "ABCDEFXY"),
                   ("S", "ZZ", 0, "none", None)]


MESSAGES = [(1, "SQL3110N  The utility has completed processing.", 0),
            (2, "SQL3205N  The row was rejected.", 0),
            (3, "SQL0100W  No row was found.", 0),
            (4, "SQL0104N  An unexpected token was found.", 0)]


def test_message_classification_fixture(spark):
    df = spark.createDataFrame(MESSAGES, "i int, text string, rc int")
    code = msg.first_code(F.col("text"))
    got = rows(df.select("i", msg.severity(code).alias("sev"), msg.escalated_rc(F.col("text"), F.col("rc")).alias("rc")))
    assert got == [(1, "ignored", 0), (2, "error", 8), (3, "warning", 0), (4, "error", 0)]


def test_error_detail_tail(spark):
    text = "noise\nSQL3109N  start\nSQL3110N  done"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(msg.error_detail(F.col("t")).alias("d")).first().d == "SQL3109N  start\nSQL3110N  done"


def test_action_table(spark):
    df = spark.createDataFrame([("SQL3608N",), ("SQL0204N",), ("",), ("SQL9999N",)], "c string")
    got = [r.a for r in df.select(msg.action_for(F.col("c")).alias("a")).collect()]
    assert got == ["add_parent", "resolve_truncated_name", "done", "unknown"]


SCRIPT = """-- DDL Statements for Table
CREATE TABLE "S1"."T1" (
  A INT );

-- DDL Statements for Foreign Keys on Table "S1"."T1"
ALTER TABLE ...
CREATE OR REPLACE VIEW V2 AS SELECT 1""".split("\n")


def test_block_extraction_fixture(spark):
    lines = spark.createDataFrame([("f", i + 1, s) for i, s in enumerate(SCRIPT)], "file string, line_no int, line string")
    got = rows(cp.extract_blocks(lines).select("kind", "schema", "name", "n_lines"))
    assert got == [("TABLE", "S1", "T1", 2), ("VIEW", "UNQUAL", "V2", 1)]


def test_block_extraction_across_chunks(spark):
    # same script repeated with large gaps: the carry-in between chunks must hold blocks together
    data = []
    for rep in range(5):
        base = rep * 1000
        data += [("f", base + 1, 'CREATE TABLE "S"."T%d" (' % rep)] + [("f", base + 1 + j, "  c%d INT ," % j) for j in range(1, 40)]
        data += [("f", base + 41, "  z INT );"), ("f", base + 42, "GRANT ...")]
    lines = spark.createDataFrame(data, "file string, line_no int, line string")
    got = rows(cp.extract_blocks(lines, chunk_lines=16).select("name", "n_lines"))
    assert got == [("T%d" % r, 41) for r in range(5)]
    # tiny fan-out: the carry itself goes through several levels
    got2 = rows(cp.extract_blocks(lines, chunk_lines=8, fanout=3).select("name", "n_lines"))
    assert got2 == got


def test_exclusive_prefix_max_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    data = [(f, p, rnd.choice([None, rnd.randint(0, 1000)])) for f in ("a", "b") for p in range(200)]
    df = spark.createDataFrame(data, "f string, p int, v int")
    got = {(r.f, r.p): r.in_v for r in cp.exclusive_prefix_max(df, ["f"], "p", ["v"], fanout=4, levels=3).collect()}
    for f, p, _ in data:
        prev = [v for ff, pp, v in data if ff == f and pp < p and v is not None]
        assert got[(f, p)] == (max(prev) if prev else None)


def test_sql_refs_and_missing_fixture(spark):
    stmts = spark.createDataFrame([(1, "SELECT a FROM S1.T1, T2 x LEFT JOIN T3 ON x.a = T3.a WHERE x.b = 1"),
                                   (2, "FETCH C1 INTO :h")], "id int, s string")
    refs = cp.table_refs(stmts, "id", "s")
    assert rows(refs.select("table_ref")) == [("S1.T1",), ("T2",), ("T3",)]
    cat = spark.createDataFrame([("S1", "T1"), ("S1", "T2"), ("S2", "T2"), ("S1", "T3")], "schema string, name string")
    assert rows(cp.missing_objects(refs, cat, ["S1", "S2"])) == [("S2", "T3")]


def test_write_objects_partitioned(spark):
    from opsward.session import scratch_path
    lines = spark.createDataFrame([("f", i + 1, s) for i, s in enumerate(SCRIPT)], "file string, line_no int, line string")
    path = cp.write_objects(lines, scratch_path(spark, "t-objects"))
    back = spark.read.parquet(path)
    got = rows(back.select("object_type", "object_schema", "object_name", "ddl"))
    assert got == [("TABLE", "S1", "T1", 'CREATE TABLE "S1"."T1" (\n  A INT );'),
                   ("VIEW", "UNQUAL", "V2", "CREATE OR REPLACE VIEW V2 AS SELECT 1")]


def test_export_exceptions_roundtrip(spark):
    from opsward.session import scratch_path
    child = spark.createDataFrame([(1, 60.0), (2, 3.0)], "k long, q double")
    tagged = ig.tag_violations(child, checks=[("ck", F.col("q") <= 50)])
    _, exc = ig.divert(tagged, lit_ts(dt.datetime(2024, 1, 31)))
    path = ig.export_exceptions(exc, scratch_path(spark, "t-exc"))
    back = spark.read.schema("k long, q double, n1_timestamp timestamp_ntz, n2_info string").option("header", True).csv(path)
    assert rows(back) == [(1, 60.0, dt.datetime(2024, 1, 31), "ck")]


def test_closure_long_chain_with_periodic_checkpoints(spark):
    n = 11
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n)] + [("n3", "n7")], "child string, parent string")
    start = spark.createDataFrame([("n0",)], "name string")
    got = dict(ig.closure(spark, start, edges, checkpoint_every=2).select("name", "depth").collect())
    expect = {f"n{i}": i for i in range(4)}
    expect.update({"n4": 4, "n7": 4, "n5": 5, "n8": 5, "n6": 6, "n9": 6, "n10": 7, "n11": 8})
    assert got == expect


def test_cascade_reaches_the_end_of_chains_and_cycles(spark):
    t = spark.createDataFrame([(1, 9, True), (2, 1, False), (3, 2, False), (4, 5, False), (5, 4, False), (6, 7, True), (7, 6, False)], "id int, up int, bad boolean")
    d = ig.divert_cascade({"t": t}, ["t"], [("t", ["up"], "t", ["id"])], {"t": ~F.col("bad")})
    assert rows(d["t"], "id", "reason") == [(1, "check"), (2, "parent:t"), (3, "parent:t"), (6, "check,parent:t"), (7, "parent:t")]
    with pytest.raises(ValueError):
        ig.divert_cascade({"t": t}, ["t"], [("t", ["up"], "missing", ["id"])], {})


def test_pending_set_and_closure_have_no_cap(spark):
    cat = spark.range(120).select(F.lit("s").alias("tabschema"), F.col("id").cast("string").alias("tabname"), F.lit(True).alias("pending"))
    refs = spark.createDataFrame([], "tabschema string, tabname string, reftabschema string, reftabname string")
    assert ig.pending_set(cat, refs).count() == 120 and ig.pending_set(cat, refs, 7).count() == 7


def test_prefixes_of_any_length(spark):
    cat = spark.createDataFrame([("s", "x" * 140 + c) for c in "abb"] + [("s", "x" * 20)], "s string, n string")
    cut = spark.createDataFrame([("s", "x" * 140), ("s", "x" * 140 + "a"), ("s", "y")], "s string, t string")
    got = rows(ig.resolve_prefix(cut, cat, "s", "n", "t"), "t", "n_matches", "resolution")
    assert got == [("x" * 140, 3, "ambiguous"), ("x" * 140 + "a", 1, "unique"), ("y", 0, "none")]
