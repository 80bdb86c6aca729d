"""One call or type that holds most rows: the work must not grow with the square of its rows."""

import random
import re

from pyspark.sql import functions as F

from callscope.operators import conversation, pii, quality, scoring


def test_context_against_a_plain_loop(spark):
    r = random.Random(5)
    texts = [r.choice([None, "", "é" * r.randrange(400), "x" * r.randrange(12), "one two"]) for _ in range(300)]
    rows = [(c, i, t) for c in ("a", None) for i, t in enumerate(texts)]
    for chars in (1, 24, 240):
        out = {(x.call_id, x.seq): x.context for x in pii.carry_context(spark.createDataFrame(rows, "call_id string, seq long, text string"), chars).collect()}
        assert out == {(c, i): " ".join(t for t in texts[:i] if t is not None)[-chars:] for c in ("a", None) for i in range(len(texts))}


def test_context_of_a_very_long_call(spark):
    """All earlier texts of every turn would be 80 GB."""
    turns = spark.range(20_000).select(F.lit("a").alias("call_id"), F.col("id").alias("seq"), F.repeat(F.lit("word "), 80).alias("text"))
    assert pii.carry_context(turns).where("length(context) = 240").count() == 19_999


def test_speakers_against_a_plain_loop(spark):
    r = random.Random(7)
    turns = [("a", i, s, s + d, f"s{i}") for i in range(120) for s, d in [(r.randrange(-50_000, 900_000), r.choice([-5, 0, 9, 3_000, 40_000, 5_000_000]))]]
    segments = [("a", i, s, s + d) for i in range(200) for s, d in [(r.randrange(-90_000, 990_000), r.choice([-7, 0, 1, 700, 20_000, 9_000_000_000]))]]

    def said(s, e):
        found = [(0, 0, i, w) for _, i, a, b, w in turns if a <= (s + e) // 2 <= b] + [(1, -o, i, w) for _, i, a, b, w in turns if (o := min(e, b) - max(s, a)) > 0]
        return min(found, default=(0, 0, 0, "unknown"))[3]

    times = spark.createDataFrame([*turns, ("a", 500, None, 10, "z"), (None, 501, 0, 10, "z")], "call_id string, idx long, start_ms long, end_ms long, speaker string")
    out = conversation.label_speakers(spark.createDataFrame([*segments, ("a", 900, None, 5), ("b", 0, 0, 5)], "call_id string, seq long, start_ms long, end_ms long"), times)
    assert {(x.call_id, x.seq): x.speaker for x in out.collect()} == {("a", i): said(s, e) for _, i, s, e in segments} | {("a", 900): "unknown", ("b", 0): "unknown"}
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line and "call_id" in line]
    assert joins and all("bucket" in line for line in joins)  # never all pairs of a call


def test_rank_counts_equal_values_first(spark):
    df = spark.createDataFrame([("a", v) for v in [3, 1, 1, 1, 2, 2, 9, None]] + [("b", None), (None, 4)], "k string, v long")
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        values = [1, 1, 1, 2, 2, 3, 9]
        want = values[min(max(round(q * 7 + 0.5), 1), 7) - 1]
        assert sorted(map(tuple, quality.nearest_rank(df, "v", "k", q).collect()), key=repr) == sorted([("a", want), (None, 4)], key=repr)
    plan = quality.nearest_rank(df, "v", "k", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # counts of ranges, not a key's values in order


def _no_pairs_of_a_call(df):
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line]
    return bool(joins) and all(re.search(r"__(id|key|q|w)#\w+ = ", line) for line in joins)


def _norm(x):
    return " ".join(x.lower().strip(" .,!?…").split())


def test_citations_against_a_plain_loop(spark):
    r = random.Random(11)
    said = [("a", r.choice(["", "A  b, ", "…"]) + " ".join(r.choice(["alpha", "be", "gamma", "d", "Überlang-wort", "x" * 30]) for _ in range(r.randrange(9)))) for _ in range(150)] + [("b", "alpha be gamma"), ("a", None), (None, "alpha be gamma")]
    quotes = [("a", t[k : k + n]) for _, t in said[:150] for k, n in [(r.randrange(12), r.choice([3, 8, 9, 14, 40]))]]
    quotes += [("b", "...ALPHA be...gam"), ("b", "x" * 9), ("c", "alpha be gamma"), ("a", "gamma d d zz be"), ("a", None), ("a", "short"), (None, "alpha be gamma"), ("b", "lpha be gamm")]
    rows = [(i, *q) for i, q in enumerate(quotes)]
    out = scoring.citation_validity(spark.createDataFrame(rows, "id long, call_id string, quote string"), spark.createDataFrame(said, "call_id string, text string"))

    def valid(c, q):
        q = _norm(q.replace("...", " ")) if q is not None else None
        return q is not None and (len(q) < 8 or any(c is not None and c == k and t is not None and q in _norm(t) for k, t in said))

    assert {x.id: x.valid for x in out.collect()} == {i: valid(c, q) for i, c, q in rows}
    assert _no_pairs_of_a_call(out)


def test_action_recall_against_a_plain_loop(spark):
    r = random.Random(13)
    vocabulary = ["refund", "refunding", "account", "tomorrow", "letter", "send", "a", "ängstlich", "accounts"]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    said = [(r.choice("ab"), line(r.randrange(4))) for _ in range(30)] + [("a", None), ("b", "prerefunded")]
    rows = [(i, r.choice("abc"), line(r.randrange(7))) for i in range(200)] + [(900, "a", None), (901, None, "refund")]
    out = scoring.action_recall(spark.createDataFrame(rows, "id long, call_id string, item string"), spark.createDataFrame(said, "call_id string, description string"))
    want = {}
    for _, c, item in rows:
        words = [w for w in _norm(item or "").split(" ") if len(w) > 4]
        hit = bool(words) and any(c == k and d is not None and sum(w in _norm(d) for w in words) >= max(1, len(words) // 2) for k, d in said)
        items, found = want.get(c, (0, 0))
        want[c] = (items + 1, found + hit)
    assert {x.call_id: (x["items"], x.found) for x in out.collect()} == want
    assert _no_pairs_of_a_call(out)
