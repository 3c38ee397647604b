"""A third of all rows on one key: results equal a brute-force computation, plans stay partial."""

import datetime as dt

from pyspark.sql import functions as F

from opsward.functions.time import lit_ts
from opsward.operators import retention as rt
from opsward.operators.latest import latest_per_entity, latest_with_ties
from opsward.operators.upsert import dedupe_latest

from conftest import rows

BASE = dt.datetime(2024, 1, 1)


def _hot(spark, n=3000):
    data = [(i, 0 if i % 3 == 0 else 1 + i % 50, BASE + dt.timedelta(minutes=(i * 7919) % 10007)) for i in range(n)]
    return spark.createDataFrame(data, "id long, e int, ts timestamp_ntz"), data


def test_keep_newest_n_hot_key(spark):
    df, data = _hot(spark)
    got = rows(rt.keep_newest_n(df, ["e"], "ts", "id", 3).select("id"))
    by = {}
    for i, e, ts in data:
        by.setdefault(e, []).append((ts, i))
    expect = sorted((i,) for e, xs in by.items() for _, i in sorted(xs, reverse=True)[3:])
    assert got == expect


def test_dedupe_and_latest_hot_key(spark):
    df, data = _hot(spark)
    best = {}
    for i, e, ts in data:
        best[e] = max(best.get(e, (0, -1)), (i, i))
    assert rows(dedupe_latest(df, ["e"], "id").select("e", "id")) == sorted((e, v[0]) for e, v in best.items())
    lt = {}
    for i, e, ts in data:
        lt[e] = max(lt.get(e, (BASE, -1)), (ts, i))
    assert rows(latest_per_entity(df, ["e"], "ts", "id").select("e", "ts", "id")) == sorted((e, t, i) for e, (t, i) in lt.items())
    maxts = {e: max(ts for _, ee, ts in data if ee == e) for e in lt}
    assert rows(latest_with_ties(df, ["e"], "ts").select("id")) == sorted((i,) for i, e, ts in data if ts == maxts[e])


def test_aggregations_combine_map_side(spark):
    df, _ = _hot(spark)
    plan = dedupe_latest(df, ["e"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan or "partial_max" in plan
