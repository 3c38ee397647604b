"""Jobs whose tasks, reads and files per driver call must not grow faster than the tables."""
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows


def test_rounds_read_no_rows_of_tables_that_were_checked(spark, tmp_path):
    from opsward.operators import rounds as ir
    facts, links = str(tmp_path / "facts"), str(tmp_path / "links")
    spark.createDataFrame([("P", 1, False), ("P", 2, True), ("K", 7, True), ("K", 8, True)], "tab string, id long, ok boolean").write.parquet(facts)
    spark.createDataFrame([("K", 7, "P", 1), ("K", 8, "P", 2), ("K", 9, "P", 3)], "tab string, id long, parent string, parent_id long").write.parquet(links)
    facts_df, links_df = spark.read.parquet(facts), spark.read.parquet(links)
    gone = spark.createDataFrame([("P", 1, "CHECK")], ir.EXCEPTIONS)
    parents = spark.createDataFrame([("P",)], "tab string")
    batch = spark.createDataFrame([("K", False, True)], "tab string, added boolean, checked boolean")
    found = ir._violations(batch, facts_df, links_df, gone, parents)
    assert rows(found) == [("K", 7, "FK")]
    assert not any("/facts/" in f for f in found.inputFiles())
    first = ir._violations(batch.withColumn("checked", F.lit(False)), facts_df, links_df, gone, parents)
    assert rows(first) == [("K", 7, "FK"), ("K", 9, "FK")]


def test_purge_joins_a_child_once(spark, tmp_path):
    from opsward import session
    from opsward.functions.time import lit_ts
    from opsward.operators import retention as rt
    op, lp, sp = (str(tmp_path / x) for x in "ols")
    spark.sql("select id o, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(int(id)) ts, concat('d', id div 3) part from range(12)").write.partitionBy("part").parquet(op)
    spark.sql("select id k, nullif(id % 13, 12) o, if(id % 4 = 0, null, concat('a b', id % 13)) part from range(52)").write.partitionBy("part").parquet(lp)
    spark.sql("select id % 60 k, id n, nullif(id % 3, 1) part from range(120)").write.partitionBy("part").parquet(sp)
    lines, ships = rows(spark.read.parquet(lp)), rows(spark.read.parquet(sp))
    app = spark.sparkContext.applicationId
    before = len([p for p in session._SCRATCH.get(app, []) if "/purge-marked-" in p])
    counts = rt.apply_purge(spark, op, "ts", lit_ts("2024-01-10 00:00:00"), 5, "part", children=[(lp, "o", "o", ["part"], [(sp, "k", "k", ["part"])])])
    gone = {k for k, o, _ in lines if o is not None and o < 4}
    left = [r for r in ships if r[0] not in gone]
    assert counts == {op: 4, lp: len(gone), sp: len(ships) - len(left)}
    assert rows(spark.read.parquet(lp)) == [r for r in lines if r[0] not in gone]
    assert rows(spark.read.parquet(sp)) == left
    assert len([p for p in session._SCRATCH[app] if "/purge-marked-" in p]) - before == 2


def test_worklist_tasks_follow_from_the_catalog(spark, tmp_path, monkeypatch):
    import duckdb

    from opsward.plans import catalog, registry
    registry.load_all()
    part = [(i, f"B{i % 3}" if i % 7 else None, "T", i % 40 if i % 5 else None, 930.0 + i if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(part + part[:20], "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double")
    df.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(catalog, "PARTS_A_TASK", 3, raising=False)
    got = registry.QUERIES["maintenance_worklist"](spark, str(tmp_path))
    # the rows are spread before they are joined and made distinct, without the text of the action
    assert got._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 4
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(registry.ORACLE["maintenance_worklist"]).fetchall()
    assert {tuple(r) for r in got.collect()} == set(want) and got.count() == len(want)


def test_exact_quantiles_without_one_buffer(spark, monkeypatch):
    from opsward.operators import catalog as ct
    rng = random.Random(3)
    data = [(rng.choice([None, rng.gauss(0, 9), float(rng.randrange(4))]), rng.randrange(5), None, rng.random() * 1e9, rng.randrange(10**6)) for _ in range(2503)]
    df = spark.createDataFrame(data, "a double, b int, c double, d double, e long").repartition(5)
    points = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    want = df.agg(*[F.percentile(c, list(points)).alias(c) for c in "abcde"]).first()

    def refused(*_):
        raise AssertionError("a single buffer holds every value")
    monkeypatch.setattr(F, "percentile", refused)
    monkeypatch.setattr(ct, "VALUES_A_TASK", 100, raising=False)
    got = {r[0]: list(r[1:]) for r in ct.quantiles(df, list("abcde"), points).collect()}
    for c in "abcde":
        assert got[c] == (list(want[c]) if want[c] is not None else [None] * len(points))
    empty = ct.quantiles(df.where("e < 0"), ["a", "e"]).collect()
    assert sorted(map(tuple, empty)) == [("a", None, None, None), ("e", None, None, None)]


def test_object_files_are_not_moved_by_the_driver(spark, tmp_path, monkeypatch):
    from opsward.operators import corpus as cp
    from opsward.sources import listing
    monkeypatch.setattr(listing, "list_files", lambda *_: pytest.fail("files are listed and moved one by one"))
    text = [("f", 2 * i + k, s) for i in range(200) for k, s in enumerate([f'CREATE TABLE "S{i % 3}"."T{i % 150}" (' if i % 2 else f"CREATE TABLE T{i} (", "  Ä INT );"])]
    lines = spark.createDataFrame(text, "file string, line_no int, line string")
    base = str(tmp_path / "o o%")
    # a file that Spark wrote, with its checksum beside it, is replaced
    spark.createDataFrame([("old",)], "value string").coalesce(1).write.text(str(tmp_path / "w"))
    (tmp_path / "o o%" / "TABLE" / "UNQUAL").mkdir(parents=True)
    old = next((tmp_path / "w").glob("part-*"))
    old.rename(tmp_path / "o o%" / "TABLE" / "UNQUAL" / "T0.ddl")
    next((tmp_path / "w").glob(".part-*.crc")).rename(tmp_path / "o o%" / "TABLE" / "UNQUAL" / ".T0.ddl.crc")
    n = cp.write_object_files(lines, base)
    files = {str(p.relative_to(base)): p.read_text() for p in (tmp_path / "o o%").rglob("*") if p.is_file()}
    assert len(files) == n and all(f.endswith(".ddl") for f in files)
    assert files["TABLE/UNQUAL/T0.ddl"] == "CREATE TABLE T0 (\n  Ä INT );\n"
    assert sorted(x for f in files.values() for x in f.splitlines()) == sorted(s for _, _, s in text)
    assert spark.read.option("recursiveFileLookup", True).text(base).count() == len(text)
