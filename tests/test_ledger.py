"""Fact tables with a commit ledger, fed by streams that fail, restart and begin anew."""

import datetime as dt
import json

import pytest

from callscope import sources
from callscope.sources import ledger
from callscope.streaming.metrics import StreamCounts

SCHEMA = "call_id string, n long, at timestamp"
AT = dt.datetime(2024, 1, 31, 12)


def rows(spark, *names):
    return spark.createDataFrame([(c, k, AT + dt.timedelta(days=k)) for k, c in enumerate(names)], SCHEMA)


def ids(spark, table):
    return sorted(r.call_id for r in ledger.read_fact(spark, table, SCHEMA).collect())


def test_a_batch_counts_once(spark, tmp_path):
    table = str(tmp_path / "t")
    assert ids(spark, table) == []
    assert ledger.append(rows(spark, "a", "b"), table, "at", "s", 0)
    assert not ledger.append(rows(spark, "a", "b"), table, "at", "s", 0)
    assert ledger.append(rows(spark, "c"), table, "at", "s", 1) and ledger.append(rows(spark, "d"), table, "at", "other", 0)
    assert ledger.append(rows(spark).limit(0), table, "at", "s", 2)
    assert ids(spark, table) == ["a", "b", "c", "d"]
    months = ledger.read_fact(spark, table, SCHEMA).where("month = '202402'")
    assert [r.call_id for r in months.collect()] == ["b"] and "PartitionFilters: [isnotnull(month" in months._jdf.queryExecution().toString()


def test_uncommitted_and_raced_rows_are_not_read(spark, tmp_path):
    table = str(tmp_path / "t")
    ledger.append(rows(spark, "a"), table, "at", "s", 0)
    ledger._written(rows(spark, "lost").selectExpr("*", "'202401' as month"), table, "dead", "month")  # a task's job that failed before its commit
    assert ids(spark, table) == ["a"]
    n = ledger._written(rows(spark, "again").selectExpr("*", "'202401' as month"), table, "race", "month")
    ledger._commit(spark, table, [("race", "s", 0, n, None, dt.datetime.now(dt.UTC))])  # a second attempt that raced
    assert ids(spark, table) == ["a"]
    assert ledger.vacuum(spark, table, older_than_hours=0) == 2 and ids(spark, table) == ["a"]


def test_compaction_and_fold(spark, tmp_path):
    table = str(tmp_path / "t")
    for k in range(5):
        ledger.append(rows(spark, f"c{k}"), table, "at", "s", k)
    before = ledger.live_entries(spark, table)
    assert ledger.compact(spark, table, SCHEMA) == 5 and len(ledger.live_entries(spark, table)) == 1
    assert ids(spark, table) == [f"c{k}" for k in range(5)]
    ledger._commit(spark, table, [("late", "compaction", 0, 0, [r.entry for r in before], dt.datetime.now(dt.UTC))])  # replaces what is replaced
    assert ids(spark, table) == [f"c{k}" for k in range(5)]
    assert not ledger.append(rows(spark, "c1"), table, "at", "s", 1)  # a replay after the compaction
    ledger.fold(spark, table)
    assert len(list((tmp_path / "t" / "ledger").glob("*.parquet"))) == 1 and ids(spark, table) == [f"c{k}" for k in range(5)]
    assert not ledger.append(rows(spark, "c1"), table, "at", "s", 1) and ledger.append(rows(spark, "x"), table, "at", "s", 5)
    assert ledger.vacuum(spark, table, older_than_hours=0) == 5 and ids(spark, table) == [*(f"c{k}" for k in range(5)), "x"]
    assert ledger.compact(spark, table, SCHEMA) == 2 and ledger.compact(spark, table, SCHEMA) == 0


def run(spark, tmp_path, checkpoint):
    q = sources.stream_to_fact(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "t"), "at", str(tmp_path / checkpoint), every="0 seconds")
    q.processAllAvailable()
    q.stop()


def test_two_streams_and_a_replayed_batch(spark, tmp_path):
    rows(spark, "c0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(spark, tmp_path, "one")
    run(spark, tmp_path, "two")  # a fresh checkpoint begins at batch 0 again
    assert ids(spark, str(tmp_path / "t")) == ["c0", "c0"]
    rows(spark, "c1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(spark, tmp_path, "one")
    for f in (tmp_path / "one" / "commits").glob("*1*"):
        f.unlink()  # the driver was lost after the append, before the stream's own commit
    run(spark, tmp_path, "one")
    assert ids(spark, str(tmp_path / "t")) == ["c0", "c0", "c1"]


SIGNAL = {
    "signal_id": "s1", "call_id": "c", "type": "intent", "label": "refund", "severity": "info", "confidence": 0.7, "rationale": "why", "policy_id": None, "window_start_ms": 5, "window_end_ms": 90,
    "evidence": [{"seq": 3, "start_ms": 1, "end_ms": 9, "speaker": "customer", "quote": "a refund"}], "emitted_at": "2024-01-01T10:00:00Z", "agent_id": None,
    "latency": {"analyze_ms": 1.5, "segment_to_signal_ms": 12.0}, "model_name": "rules", "prompt_version": "v1", "traceparent": "00-abc-1-01",
}
SUMMARY = {
    "call_id": "c", "summary": "It ended.", "resolution": "resolved", "primary_intent": "refund", "secondary_intents": ["card"], "action_items": [{"description": "call back", "owner": "agent", "evidence": SIGNAL["evidence"]}],
    "customer_sentiment_start": -0.5, "customer_sentiment_end": 0.25, "escalated": True, "compliance_violations": ["P1"], "disclosures_given": [], "model_name": "m", "prompt_version": "v2", "generated_at": "",
}
LIVE = {"schema_version": "1.3", "kind": "live", "call_id": "c", "agent_id": "E7", "emitted_at": "2024-01-01T10:00:01Z", "signals": [SIGNAL, {**SIGNAL, "signal_id": "s2", "agent_id": "A1", "emitted_at": "soon", "evidence": [], "latency": {}}], "traceparent": None}
POST = {"kind": "post_call", "call_id": "c", "agent_id": "E7", "emitted_at": "2024-01-01T11:00:00Z", "summary": SUMMARY, "traceparent": "00-def-1-01"}
BAD = ["no json", json.dumps({**LIVE, "schema_version": "2.0"}), json.dumps({**LIVE, "kind": "other"}), json.dumps({**LIVE, "signals": []}), json.dumps({**POST, "summary": None}), json.dumps({**POST, "call_id": ""}), "[]"]


def test_envelopes_reach_all_three_fact_tables(spark, tmp_path):
    lines = [json.dumps(LIVE), json.dumps(POST), *BAD]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    df = spark.read.text(str(tmp_path / "in"))
    assert [r.reason for r in sources.read_insights(df.coalesce(1)).collect()] == [None, None, "json", "version", "kind", "payload", "payload", "call_id", "json"]
    want = {name: rows.count() for name, rows in sources.insight_rows(df).items()}
    assert want == {"signals": 2, "latencies": 2, "summaries": 1}
    for _ in range(2):  # the second run finds nothing new
        q = sources.sink_insights(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "facts"), str(tmp_path / "cp"), once=True)
        q.awaitTermination(120)
    own = {name: ledger.read_fact(spark, str(tmp_path / "facts" / name), rows.schema, sources.FACT_TABLES[name][1]) for name, rows in sources.insight_rows(df).items()}
    s = {r.signal_id: r for r in own["signals"].collect()}
    assert (s["s1"].agent_id, s["s2"].agent_id, s["s1"].signal_type, s["s1"].trace_id, s["s1"].policy_id) == ("E7", "A1", "intent", "abc", "")
    assert (list(s["s1"].evidence_quote), list(s["s2"].evidence_quote), s["s1"].latency_analyze_ms, s["s1"].latency_asr_ms) == (["a refund"], [], 1.5, None)
    assert s["s1"].emitted_at == dt.datetime(2024, 1, 1, 10) and s["s2"].emitted_at is not None and s["s1"].month == "202401"
    assert sorted((r.seq, r.stage, r.duration_ms, r.day) for r in own["latencies"].collect()) == [(3, "analyze", 1.5, "20240101"), (3, "e2e", 12.0, "20240101")]
    (x,) = own["summaries"].collect()
    assert (x.agent_id, x.escalated, x.violation_count, x.sentiment_delta, list(x.action_item_owners), x.trace_id) == ("E7", 1, 1, 0.75, ["agent"], "def")
    assert x.started_at == x.ended_at == dt.datetime(2024, 1, 1, 11)


def segment(call, seq, at, **more):
    return json.dumps({"call_id": call, "seq": seq, "speaker": "agent", "text": "x", "is_final": True, "start_ms": 0, "end_ms": 1, "emitted_at": at} | more)


def test_a_stream_counts_rejects_and_late_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    parts = [
        [segment("a", 0, "2024-01-01T10:00:00Z"), "{", segment("", 1, "2024-01-01T10:00:00Z"), segment("a", 1, "2024-01-01T12:00:00Z", schema_version="1.9")],
        [segment("a", 2, "2024-01-01T12:00:01Z"), segment("a", 3, "2024-01-01T12:00:02Z", schema_version="2.0")],
        [segment("a", 4, "2024-01-01T09:00:00Z"), segment("a", 5, "2024-01-01T12:00:03Z"), "[]"],
    ]
    for k, lines in enumerate(parts):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(lines))
    counts = StreamCounts()
    spark.streams.addListener(counts)
    try:
        from callscope.streaming import dedupe_stream

        df = dedupe_stream(sources.observed_segments(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))), "10 minutes")
        q = df.writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        import time

        for _ in range(50):
            if counts.totals(q.id).get("lines") == 9:
                break
            time.sleep(0.2)
        got = counts.totals(q.id)
    finally:
        spark.streams.removeListener(counts)
    assert {k: got[k] for k in ("lines", "rejected_json", "rejected_call_id", "rejected_version", "late")} == {"lines": 9, "rejected_json": 2, "rejected_call_id": 1, "rejected_version": 1, "late": 1}
    assert spark.table("counted").count() == 4


def test_keyed_segments(spark):
    rows = [("a", segment("a", 0, "2024-01-01T10:00:00Z")), ("b", segment("a", 1, "2024-01-01T10:00:00Z")), (None, segment("c", 2, "2024-01-01T10:00:00Z")), ("d", "nothing")]
    df = spark.createDataFrame(rows, "key string, value string")
    assert sorted(r.call_id for r in sources.read_keyed_segments(df).collect()) == ["a", "c"]
    assert sorted(r.call_id for r in sources.read_keyed_segments(df.selectExpr("cast(key as binary) key", "cast(value as binary) value"), "m").collect()) == ["a", "c"]


@pytest.mark.parametrize("rows,want", [([("c", 0, True, "b"), ("c", 0, True, "a")], 1), ([("c", 0, True, "a"), ("c", 0, False, "a")], 2)])
def test_ties_of_arrival_do_not_hang_on_the_order_of_rows(spark, rows, want):
    from callscope.operators import contracts

    schema = "call_id string, seq int, is_final boolean, text string"
    ways = [spark.createDataFrame(r, schema).selectExpr("*", "timestamp'2024-01-01' as emitted_at") for r in (rows, rows[::-1])]
    for act in (contracts.dedupe_segments, contracts.latest_hypothesis):
        a, b = (sorted(map(tuple, act(w).collect())) for w in ways)
        assert a == b and (act is contracts.latest_hypothesis or len(a) == want)
