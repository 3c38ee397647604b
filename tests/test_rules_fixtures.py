"""FIXTURES 3.1-3.4: rule resolution, schedule, freshness, state and retention — hand-derived answers."""

import datetime as dt

from pyspark.sql import functions as F

from opsward.functions.dow import dow_matches
from opsward.functions.time import lit_ts, whole_hours
from opsward.operators import retention as rt
from opsward.operators import status as st
from opsward.operators.rules import resolve
from opsward.sources.rules import parse_threshold_rules

from conftest import rows

RULES = """*:*:*:*:regular:48;120
h1:i1:*:*:regular:0
h1:i1:D1:*:regular:100;110
h2:i2:*:2-6:regular:24;72
h3:i3:*:1,3,5:regular:36
*:*:*:*:snapshot:0""".split("\n")


def _rules(spark, lines):
    df = spark.createDataFrame([("f", i + 1, s) for i, s in enumerate(lines)], "file string, line_no int, line string")
    return parse_threshold_rules(df)


def _resolved(spark, lines, cases):
    ent = spark.createDataFrame(cases, "case_id int, host string, instance string, dbname string, day int, kind string")
    r = resolve(ent, _rules(spark, lines), ["case_id", "host", "instance", "dbname", "day"], ["warn_h", "crit_h", "dow"],
                match_cols=["kind"])
    return r.select("case_id", "warn_h", "crit_h",
                    st.schedule_state(F.col("crit_h"), dow_matches(F.col("dow"), F.col("day"))).alias("schedule"))


CASES = [
    (1, "h1", "i1", "D1", 3, "regular"), (2, "h1", "i1", "D2", 3, "regular"), (3, "h2", "i2", "X", 3, "regular"),
    (4, "h2", "i2", "X", 7, "regular"), (5, "h3", "i3", "X", 3, "regular"), (6, "h3", "i3", "X", 2, "regular"),
    (7, "h9", "i9", "X", 4, "regular"), (8, "h9", "i9", "X", 4, "snapshot"),
]
EXPECTED = [(1, 100, 110, "active"), (2, 0, 0, "disabled"), (3, 24, 72, "active"), (4, 24, 72, "not_today"),
            (5, 0, 36, "active"), (6, 0, 36, "not_today"), (7, 48, 120, "active"), (8, 0, 0, "disabled")]


def test_rule_resolution_fixture(spark):
    assert rows(_resolved(spark, RULES, CASES)) == EXPECTED


def test_resolution_case_insensitive_and_order_independent(spark):
    shuffled = list(reversed(RULES))  # line numbers change with order -> same winners because no ties here
    upper = [l.upper().replace("REGULAR", "regular").replace("SNAPSHOT", "snapshot") for l in RULES]
    assert rows(_resolved(spark, upper, CASES)) == EXPECTED
    assert rows(_resolved(spark, shuffled, CASES)) == EXPECTED


def test_last_line_wins_within_level(spark):
    lines = ["*:*:*:*:regular:48;120", "h1:*:*:*:regular:10;20", "h1:*:*:*:regular:30;40"]
    got = rows(_resolved(spark, lines, [(1, "h1", "i1", "D1", 3, "regular")]))
    assert got == [(1, 30, 40, "active")]


def test_invalid_shape_never_matches(spark):
    lines = ["*:*:*:*:regular:48;120", "h1:*:D1:*:regular:1;2", "*:i1:*:*:regular:3;4"]
    assert rows(_resolved(spark, lines, [(1, "h1", "i1", "D1", 3, "regular")])) == [(1, 48, 120, "active")]


def test_comments_blanks_leading_spaces(spark):
    lines = ["# comment", "", "   h1:*:*:*:regular:7;8", "#h1:*:*:*:regular:1;1"]
    got = rows(_rules(spark, lines), "line_no", "host", "warn_h", "crit_h")
    assert got == [(3, "h1", 7, 8)]


def test_dow_items_and_ranges(spark):
    specs = ["*", "1", "1-5", "1,3,5", "1-5,7", "6-7"]
    df = spark.createDataFrame([(s, d) for s in specs for d in range(1, 8)], "spec string, d int")
    got = {(r.spec, r.d): r.ok for r in df.select("spec", "d", dow_matches(F.col("spec"), F.col("d")).alias("ok")).collect()}
    assert all(got[("*", d)] for d in range(1, 8))
    assert [d for d in range(1, 8) if got[("1,3,5", d)]] == [1, 3, 5]
    assert [d for d in range(1, 8) if got[("1-5,7", d)]] == [1, 2, 3, 4, 5, 7]
    assert [d for d in range(1, 8) if got[("6-7", d)]] == [6, 7]


AS_OF = dt.datetime(2024, 1, 31)


def test_freshness_fixture(spark):
    latest = [(1, "20240129000000"), (2, "20240128230000"), (3, "20240126000000"), (4, "20240125230000"), (5, None)]
    df = spark.createDataFrame(latest, "e int, t14 string")
    age = whole_hours(F.to_timestamp_ntz("t14", F.lit("yyyyMMddHHmmss")), lit_ts(AS_OF))
    got = rows(df.select("e", age.alias("age"), st.freshness_code(age, F.lit(48), F.lit(120)).alias("code")))
    assert got == [(1, 48, 0), (2, 49, 1), (3, 120, 1), (4, 121, 2), (5, None, 2)]


def test_whole_hours_truncates(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 30, 0, 1),)], "t timestamp_ntz")
    assert df.select(whole_hours(F.col("t"), lit_ts(AS_OF)).alias("h")).first().h == 23


def test_fixed_threshold_variant(spark):
    df = spark.createDataFrame([(99,), (100,), (199,), (200,), (None,)], "a int")
    got = [r.c for r in df.select(st.fixed_freshness_code(F.col("a")).alias("c")).collect()]
    assert got == [0, 1, 1, 2, 2]


STATE_CASES = [
    (1, "IMPLICIT", "INACTIVE", "EXPLICIT", 0), (2, "IMPLICIT", "INACTIVE", "IMPLICIT", 1),
    (3, "IMPLICIT", "INACTIVE", "INACTIVE", 2), (4, "IMPLICIT", "INACTIVE", "UNKNOWN", 1),
    (5, "INACTIVE", "", "INACTIVE", 1), (6, "EXPLICIT", "INACTIVE", "IMPLICIT", 1),
    (7, "IMPLICIT", "INACTIVE", None, 3),
]


def test_state_status_fixture(spark):
    df = spark.createDataFrame(STATE_CASES, "i int, w string, c string, s string, expected int")
    got = df.select("i", "expected", st.activation_code(F.col("s"), F.col("w"), F.col("c")).alias("code")).collect()
    assert all(r.code == r.expected for r in got), [(r.i, r.code, r.expected) for r in got]


def test_quiesce_codes(spark):
    df = spark.createDataFrame([(None, False, False), (False, False, False), (True, True, False), (True, False, False),
                                (True, False, True)], "a boolean, q boolean, b boolean")
    got = [r.c for r in df.select(st.quiesce_code(F.col("a"), F.col("q"), F.col("b")).alias("c")).collect()]
    assert got == [3, 3, 2, 0, 1]


def _copies(spark, entity, ages_hours):
    return [(entity * 100 + i, entity, AS_OF - dt.timedelta(hours=h)) for i, h in enumerate(ages_hours)]


def test_retention_fixture(spark):
    # ages in whole days: (0,0,1,9), (0,1,2,9), (5,9)
    data = (_copies(spark, 1, [1, 2, 25, 9 * 24 + 1]) + _copies(spark, 2, [1, 25, 49, 9 * 24 + 1])
            + _copies(spark, 3, [5 * 24 + 1, 9 * 24 + 1]))
    df = spark.createDataFrame(data, "id long, e int, ts timestamp_ntz")
    age = F.timestamp_diff("DAY", F.col("ts"), lit_ts(AS_OF))
    count_mode = rt.keep_newest_n(df, ["e"], "ts", "id", 2, mode="count")
    both = rt.keep_newest_n(df, ["e"], "ts", "id", 2, mode="count_and_age", as_of=lit_ts(AS_OF))
    assert rows(count_mode.select("e", age.alias("a"))) == [(1, 1), (1, 9), (2, 2), (2, 9)]
    assert rows(both.select("e", age.alias("a"))) == [(1, 9), (2, 2), (2, 9)]


def test_purge_whole_days(spark):
    df = spark.createDataFrame([(1, AS_OF - dt.timedelta(days=30, hours=23)), (2, AS_OF - dt.timedelta(days=31))],
                               "id int, ts timestamp_ntz")
    assert rows(rt.purge_whole_days(df, "ts", lit_ts(AS_OF), 30).select("id")) == [(2,)]


def test_purge_partition(spark):
    df = spark.createDataFrame([(i, AS_OF - dt.timedelta(days=i)) for i in range(10)] + [(99, None)],
                               "id int, ts timestamp_ntz")
    kept, purged = rt.purge_by_age(df, "ts", lit_ts(AS_OF), 5)
    assert sorted(rows(kept.select("id")) + rows(purged.select("id"))) == rows(df.select("id"))
    assert (99,) in rows(kept.select("id"))


def test_next_version(spark):
    df = spark.createDataFrame([("20240101_00",), ("20240101_03",), ("20240102_00",), ("junk",)], "folder string")
    assert rows(rt.next_version(df)) == [("20240101", "20240101_04"), ("20240102", "20240102_01")]


def test_resolution_without_broadcast_is_identical(spark):
    ent = spark.createDataFrame(CASES, "case_id int, host string, instance string, dbname string, day int, kind string")
    cols = ["case_id", "host", "instance", "dbname", "day"]
    want = rows(resolve(ent, _rules(spark, RULES), cols, ["warn_h", "crit_h", "dow"], match_cols=["kind"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = resolve(ent, _rules(spark, RULES), cols, ["warn_h", "crit_h", "dow"], match_cols=["kind"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
        assert rows(got) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entity_without_a_rule_stays_with_defaults(spark):
    ent = spark.createDataFrame([(1, "h1", "i1", "D1"), (2, "h2", "i1", "D1"), (3, None, None, None)], "case_id int, host string, instance string, dbname string")
    rules = _rules(spark, ["h1:*:*:*:regular:1;2"])
    got = resolve(ent.withColumn("kind", F.lit("regular")), rules, ["case_id"], ["warn_h", "crit_h"], match_cols=["kind"], defaults={"warn_h": 48, "crit_h": 120})
    assert rows(got, "case_id", "line_no", "warn_h", "crit_h") == [(1, 1, 1, 2), (2, None, 48, 120), (3, None, 48, 120)]
    bare = resolve(ent, rules.where("host = '*'"), ["case_id"], ["warn_h"])
    assert rows(bare, "case_id", "warn_h") == [(1, None), (2, None), (3, None)]


def test_many_lines_of_one_key_meet_an_entity_once(spark):
    """Lines of a key are reduced before the join: ten times the lines give the same number of joined rows."""
    ent = spark.range(200).select(F.col("id").cast("int").alias("case_id"), F.lit("h").alias("host"), F.lit("i").alias("instance"), F.lit("d").alias("dbname"))
    for n in (100, 1000):
        rules = spark.range(n).select(F.col("id").alias("line_no"), F.lit("h").alias("host"), F.lit("i").alias("instance"), F.lit("d").alias("dbname"), F.col("id").cast("int").alias("v"))
        got = resolve(ent, rules, ["case_id"], ["v"])
        assert got.count() == 200 and {r.v for r in got.collect()} == {n - 1}
        assert "Aggregate" in got._jdf.queryExecution().optimizedPlan().toString()


def test_lines_and_overall_code_know_off_days_and_invalidated_backups(spark, monkeypatch):
    """Hand-made checks of each kind: what the line says, and what they add up to."""
    from opsward.plans import freshness as fr
    day = "2024-01-31 10:00:00"  # a Wednesday
    rules = ["*:*:*:*:regular:48;120", "h1:*:*:1-2:regular:48;120", "h2:*:*:*:regular:24;96", "h3:*:*:*:regular:0", "*:*:*:*:snapshot:0"]
    lines = spark.createDataFrame([("f", i + 1, r) for i, r in enumerate(rules)], "file string, line_no int, line string")
    from opsward.sources.rules import parse_threshold_rules
    monkeypatch.setattr(fr, "parsed_rules", lambda *_: parse_threshold_rules(lines).drop("file"))
    ent = spark.createDataFrame([(i, h, "i", "D") for i, h in ((1, "h1"), (2, "h2"), (3, "h3"), (4, "h4"), (5, "h4"), (6, "h2"))], "entity_id int, host string, instance string, dbname string")
    monkeypatch.setattr(fr, "entities", lambda *_: ent)
    backups = spark.createDataFrame([(1, "2024-01-31 09:30:00"), (2, "2024-01-31 08:00:00"), (4, "2024-01-28 10:00:00"), (6, "2024-01-31 00:00:00")], "entity_id int, t string")
    monkeypatch.setattr(fr, "latest_backups", lambda *_: backups.selectExpr("entity_id", "'regular' kind", "cast(t as timestamp_ntz) latest_time", "1 event_id"))
    bad = spark.createDataFrame([(2, "regular", "finding text"), (1, "regular", "not looked at")], "entity_id int, kind string, finding string")
    monkeypatch.setattr(fr, "invalidated", lambda *_: bad)
    monkeypatch.setattr(fr, "as_of_events", lambda: F.lit(day).cast("timestamp_ntz"))
    got = {r.entity_id: r.line for r in fr.q_status_lines(spark, "").collect()}
    head = "Age_last_backup_regular_{}_i_D_{} "
    assert got == {
        1: "0 " + head.format("h1", 1) + "age_hours=48;120;0; OK - No check configured for today for a regular backup",
        2: "2 " + head.format("h2", 2) + "age_hours=0;48;120;0; CRITICAL - regular finding text",
        4: "1 " + head.format("h4", 4) + "age_hours=72;48;120;0; WARNING - 72 hours since last full backup at 2024-01-28 10:00:00",
        5: "2 " + head.format("h4", 5) + "age_hours=0;48;120;0; CRITICAL - regular backup never taken",
        6: "0 " + head.format("h2", 6) + "age_hours=10;24;96;0; OK - 10 hours since last full backup at 2024-01-31 00:00:00"}
    assert rows(fr.q_overall_status(spark, "")) == [("h1", 1, 0, 0), ("h2", 2, 2, 8), ("h4", 2, 3, 8)]
