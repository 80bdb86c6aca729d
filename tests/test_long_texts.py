"""Texts of very many matches, and the array folds that keep them linear."""

import random
import time

import pytest
from pyspark.sql import functions as F

from callscope.functions.arrays import PART, running
from callscope.operators import conversation, pii, scoring

LONG = 20_000


@pytest.mark.parametrize("n", [0, 1, PART, PART + 1, 3 * PART - 1])
def test_running(spark, n):
    values = [random.Random(n).randrange(-9, 9) for _ in range(n)]
    df = spark.createDataFrame([(values,), (None,)], "v array<int>")
    got = [(r.a, r.b) for r in df.select(running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("a"), running(F.col("v"), F.lit(-99), F.greatest).alias("b")).collect()]
    assert got[0] == ([sum(values[: i + 1]) for i in range(n)], [max(values[: i + 1]) for i in range(n)])


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0], s[1] - s[2], -s[3], s[1])):
        if all(s[2] <= o[1] or o[2] <= s[1] for o in kept):
            kept.append(s)
    return sorted(kept)


def test_overlaps_against_a_plain_loop(spark):
    r = random.Random(5)
    rows = []
    for k in range(60):
        spans = []
        for _ in range(r.choice((0, 1, 2, 30, 300))):
            at = r.randrange(600)
            spans.append((r.randrange(4), at, at + r.randrange(1, 12), round(r.random(), 3)))
        rows.append((k, sorted(set(spans))))
    df = spark.createDataFrame(rows, "k int, spans array<struct<rank:int,start:int,end:int,confidence:double>>")
    for x in df.select("k", pii.resolve_overlaps(F.col("spans")).alias("kept")).collect():
        assert sorted(map(tuple, x.kept)) == greedy(rows[x.k][1])


def test_long_lists_are_redacted_in_time(spark):
    text = " ".join(f"u{k}@example.org" for k in range(LONG))
    df = spark.createDataFrame([("c", 0, text), ("d", 0, "nobody")], "call_id string, seq int, text string")
    pii.redact(df.limit(0), ["email"]).collect()
    began = time.time()
    out = {r.call_id: r for r in pii.redact(df, ["email"]).collect()}
    assert out["c"].n_redactions == LONG and time.time() - began < 60
    assert out["c"].text.startswith("<EMAIL_1> <EMAIL_2> ") and out["c"].text.endswith(f"<EMAIL_{LONG}>") and out["d"].text == "nobody"
    assert all(out["c"].text[m.start : m.end] == m.placeholder for m in out["c"].redactions[:: LONG // 50])


def test_spans_against_labels_in_one_sweep(spark):
    schema = "call_id int, seq int, type string, start int, end int"
    r = random.Random(2)
    some = lambda n: [(r.randrange(3), 0, r.choice("ab"), (at := r.randrange(300)), at + r.randrange(0, 9)) for _ in range(n)]
    spans, labels = some(400), some(120)
    want = {}
    for c, q, t, s, e in spans:
        if not any(c == c2 and s2 < e and s < e2 for c2, _, _, s2, e2 in labels):
            want[t] = want.get(t, 0) + 1
    assert {x.type: x.false_positives for x in scoring.false_positives(spark.createDataFrame(spans, schema), spark.createDataFrame(labels, schema)).collect()} == want
    many = spark.range(LONG).selectExpr("1 as call_id", "0 as seq", "'a' as type", "cast(id * 10 as int) as start", "cast(id * 10 + 5 as int) as end")
    assert scoring.false_positives(many, many.where("start % 20 = 0")).first().false_positives == LONG // 2


def test_only_hits_leave_a_row(spark):
    turns = spark.createDataFrame([("c", 0, "agent", "we guarantee it"), ("c", 1, "customer", "a supervisor")], "call_id string, seq int, speaker string, text string")
    for df in (conversation.pattern_hits(turns, [("(?i)super", 0.5, "s")]), conversation.phrase_hits(turns, [("P", "guarantee")])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "filter(" in plan and df.count() == 1
