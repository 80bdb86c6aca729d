"""Order statistics by selection, versions of summaries in sketches, nested unknown keys, split counters."""

import random

import pytest

from callscope.operators import contracts, marts, order, quality
from callscope.operators.order import order_statistics


@pytest.mark.parametrize("left,ranges", [(4096, 512), (64, 64)])
def test_selection_is_percentile(spark, monkeypatch, left, ranges):
    monkeypatch.setattr(order, "LEFT", left)
    monkeypatch.setattr(order, "RANGES", ranges)
    r = random.Random(left)
    values = {"a": [r.gauss(0, 50) for _ in range(900)], "b": [7.0] * 300, "c": [1.5], "d": [2.0**k for k in range(-40, 40)], "e": [float(k % 5) for k in range(200)] + [None] * 9, "f": [None], "g": [-1e308, 0.0, 1e308] * 5}
    df = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k string, v double").repartition(5)
    got = {x.k: (x.low, x.p50, x.p99, x.top) for x in order.selected_quantiles(df, ["k"], "v", {"low": 0.0, "p50": 0.5, "p99": 0.99, "top": 1.0}).collect()}
    want = {x.k: tuple(x.q) for x in df.where("v is not null").groupBy("k").agg({"v": "max"}).join(df.groupBy("k").agg(__import__("pyspark").sql.functions.expr("percentile(v, array(0D, 0.5D, 0.99D, 1D)) as q")), "k").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    ranks = spark.createDataFrame([("a", 0), ("a", 899), ("a", 900), ("b", 17), ("x", 0)], "k string, rank long")
    assert sorted((x.k, x["rank"], x.value) for x in order_statistics(df, ["k"], "v", ranks).collect()) == [("a", 0, min(values["a"])), ("a", 899, max(values["a"])), ("b", 17, 7.0)]
    assert order.selected_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
    assert {x.k: x.value for x in quality.nearest_rank(df, "v", "k", 0.5).collect()}["c"] == 1.5


def test_no_window_gathers_a_key(spark):
    df = spark.range(50_000).selectExpr("id % 2 as k", "cast(id as double) as v")
    ranks = spark.createDataFrame([(0, 100), (1, 20_000)], "k long, rank long")
    out = order_statistics(df, ["k"], "v", ranks)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x.k, x.value) for x in out.collect()) == [(0, 200.0), (1, 40_001.0)]


def test_a_second_version_counts_a_call_once(spark):
    schema = "call_id string, agent_id string, ended_date date, version int, escalated int, violation_count int, resolution string, sentiment_end double, sentiment_start double, turn_count int"
    import datetime as dt

    day = dt.date(2024, 1, 1)
    rows = [(f"c{k}", "A", day, 1, 0, 1, "resolved", 0.5, 0.0, 4) for k in range(6)] + [("c0", "A", day, 2, 1, 0, "resolved", 0.1, 0.0, 5), ("c1", "B", day, 3, 1, 0, "x", 0.1, 0.0, 5)]
    df = spark.createDataFrame(rows, schema)
    plain = {r.agent_id: r.calls for r in marts.rollup_agent_daily(df).collect()}
    once = {r.agent_id: (r.calls, r.escalations, r.violations, r.turns) for r in marts.rollup_agent_daily(df, "version").collect()}
    assert plain == {"A": 7, "B": 1} and once == {"A": (5, 1, 4, 21), "B": (1, 1, 0, 5)}
    rollup = marts.rollup_call_sketches(df, "version")
    assert {r.agent_id: r.calls for r in marts.merge_call_sketches(rollup, ["agent_id"]).collect()} == {"A": 5, "B": 1}
    assert marts.merge_call_sketches(rollup, ["ended_date"]).first().calls == 6
    assert {r.policy_id: r.calls for r in marts.policy_violation_rates(spark.createDataFrame([("k", "P", "c", "high", 0.5)] * 3, "signal_type string, policy_id string, call_id string, severity string, confidence double"), "k", exact=False).collect()} == {"P": 1}


def test_unknown_paths(spark):
    rows = [(1, '{"a": {"b": 1, "x": {"y": 2}}, "r": [{"t": 1}, {"t": 2, "n": {}}], "q": 1}'), (2, "no json"), (3, None), (4, "[1, 2]"), (5, '{"a": [{"b": 1}]}'), (6, "{}")]
    df = spark.createDataFrame(rows, "k int, body string")
    got = sorted((r.k, r.path) for r in contracts.unknown_paths(df, "body", ["a.b", "r[].t"], ("k",)).collect())
    assert got == [(1, "a.x"), (1, "q"), (1, "r[].n"), (4, "[]"), (5, "a[]")]
