"""Literal cases of the rules of calls, contracts, detectors and fact rows."""

import pytest
from pyspark.sql import functions as F

from callscope import rules, streaming
from callscope.operators import contracts, conversation, facts, marts, pii, quality

TURN = "call_id long, seq long, speaker string, text string"


def turns(spark, *rows):
    return spark.createDataFrame([(c, i, s, t) for i, (c, s, t) in enumerate(rows)], TURN)


def mood(df):
    return conversation.score_sentiment(df, rules.MOOD_WORDS, rules.NEGATIONS, rules.INTENSIFIERS, 3, rules.MOOD_PHRASES)


def test_moods(spark):
    said = {
        "thank you": 0.675,  # the phrase alone: 0.5 * 1.35
        "thank you, that is great": (0.5 + 0.5) / 2 * 1.35,
        "I am locked out": -0.4 * 1.35,
        "no one listens": -0.4 * 1.35,  # "no" negates, the phrase counts once and isn't flipped
        "not happy": -0.6 * 0.8 * 1.35,
        "very angry": -1.0,  # -0.8 * 1.4 * 1.35, clamped
        "I cannot say": 0.0,  # a negation has no weight of its own
        "master card": 0.0, "": 0.0, None: 0.0,
    }
    df = turns(spark, *[(1, "customer", t) for t in said])
    got = {r.text: r.sentiment for r in mood(df).collect()}
    assert got == {t: pytest.approx(v) for t, v in said.items()}


def test_risk_of_a_bad_mood_without_hits(spark):
    df = turns(
        spark, (1, "customer", "this is horrible and useless and disgusted"), (2, "customer", "I want a supervisor"), (2, "customer", "thank you, perfect, wonderful"),
        (2, "customer", "great"), (2, "customer", "excellent"), (3, "customer", "a supervisor now, this is terrible"), (4, "agent", "the supervisor"), (5, "customer", "hello"),
    )
    out = {r.call_id: (r.risk, r.band) for r in conversation.escalation_risk(df, conversation.pattern_hits(df, rules.ESCALATION), mood(df)).collect()}
    assert out[1] == (0.75, "high")  # mood -1: 0.45 + 0.3 at most
    assert out[2] == (0.495, "medium")  # 0.9 * 0.55
    assert out[3] == (0.75, "high") and out[4] == (0.0, "none") and out[5] == (0.0, "none")


def test_resolutions_and_their_turns(spark):
    df = turns(
        spark, (1, "customer", "is there a supervisor"), (1, "agent", "I'll transfer you"), (1, "customer", "ok"), (2, "agent", "we'll be in touch"), (2, "customer", "thank you"),
        (3, "customer", "thank you"), (3, "agent", "bye"), (4, "agent", "bye"), (5, "agent", "thank you"), *[(5, "agent", "x")] * 5, (6, "customer", "escalated, no words"),
    )
    up = spark.createDataFrame([(1, True), (2, False), (6, True)], "call_id long, escalated boolean")
    got = {r.call_id: (r.resolution, r.seq) for r in conversation.classify_resolution(df, rules.FOLLOW_UP, rules.RESOLVED, up, rules.ESCALATED).collect()}
    assert got == {1: ("escalated", 1), 2: ("follow_up_required", 3), 3: ("resolved", 5), 4: ("unresolved", 7), 5: ("unresolved", 13), 6: ("escalated", 14)}


def test_actions(spark):
    df = turns(
        spark, (1, "agent", "I'll go ahead and send the new card, and I'll see what I can do."), (1, "agent", "I'm crediting the fee. Let me cancel the old order."),
        (1, "agent", "You'll need to reset the password"), (1, "customer", "I'll send the form"), (1, "agent", "We'll SEND THE NEW CARD"),
    )
    got = {(r.seq, r.description, r.owner) for r in conversation.action_items(df, rules.ACTIONS, rules.ACTION_NOISE).collect()}
    assert got == {(0, "send the new card", "agent"), (1, "crediting the fee", "agent"), (1, "cancel the old order", "agent"), (2, "reset the password", "customer")}


def test_missing_disclosures_cite_the_first_agent_turn(spark):
    df = turns(spark, (1, "customer", "hi"), (1, "agent", "hello"), (1, "agent", "this call is recorded"), (2, "agent", "hi"), (2, "agent", "x"), (2, "agent", "y"), (2, "agent", "recorded"))
    status = conversation.disclosure_status(df, [("REC", "recorded", 3), ("REC", "taped", 3)])
    assert {(r.call_id, r.given, r.seq, r.anchor) for r in status.collect()} == {(1, True, 2, 2), (2, False, None, 3)}
    policies = spark.createDataFrame([("REC", "Recording notice", "high")], "policy_id string, title string, severity string")
    assert [tuple(r) for r in conversation.missing_disclosures(status, policies).collect()] == [(2, 3, "REC", "Recording notice", 0.8)]


def test_a_rejected_segment_is_nothing_to_repeat(spark):
    rows = [(1, "c", 0, "nobody", "x", True), (2, "c", 0, "agent", "x", True), (3, "c", 0, "agent", "x", True), (4, "c", 0, "ghost", "x", True), (5, "c", 0, "agent", "x", False)]
    df = spark.createDataFrame(rows, "arrived int, call_id string, seq int, speaker string, text string, is_final boolean")
    got = {(r.outcome, r.reason): r.segments for r in contracts.ingest_outcomes(df, "arrived").collect()}
    assert got == {("rejected", "speaker"): 2, ("accepted", ""): 2, ("duplicate", ""): 1}


def spans(spark, text, kind):
    df = spark.createDataFrame([(1, 0, text)], "call_id long, seq long, text string")
    return [(r.type, text[r.start : r.end], round(r.confidence, 2)) for r in pii.pii_spans(df, [kind]).orderBy("start").collect()]


def test_formatted_detectors(spark):
    assert spans(spark, "my account number 12345-678 please", "account_labelled") == [("ACCOUNT", "12345-678", 0.9)]
    assert spans(spark, "account 1 - - - 2", "account_labelled") == []
    assert spans(spark, "born on 4/5/1980", "dob_numeric") == [("DOB", "4/5/1980", 0.95)]
    assert spans(spark, "due on 4/5/2020", "dob_numeric") == [("DOB", "4/5/2020", 0.75)]
    assert spans(spark, "birthday May 4th, 1980; paid on 3 June 2021" + " " * 80 + "on 7 July 2022", "dob_wordy") == [("DOB", "May 4th, 1980", 0.93), ("DOB", "3 June 2021", 0.93), ("DOB", "7 July 2022", 0.7)]
    assert spans(spark, "at 12 Old Mill Road, apt 4b now", "address") == [("ADDRESS", "12 Old Mill Road, apt 4b", 0.8)]
    assert spans(spark, "My name is Ana Lee. I'm Okay and this is  Bo Ray Kim Day, name on the account is Ed", "person_trigger") == [("PERSON", "Ana Lee", 0.75), ("PERSON", "Bo Ray Kim", 0.75), ("PERSON", "Ed", 0.75)]
    assert spans(spark, "so Ana Lee met Visa Card on Fenwick Road. Good Day", "person_run") == [("PERSON", "Ana Lee", 0.55)]
    assert spans(spark, "write j dot x at example dot com, meet at four dot thirty", "spoken_email") == [("EMAIL", "j dot x at example dot com", 0.85)]
    assert spans(spark, "joe at bardotcom", "spoken_email") == []  # no word that names a domain


def test_long_lists_do_not_overflow(spark):
    text = " . ".join("abcdefgh"[k % 8] for k in range(8_000)) + " Ab" * 40_000
    df = spark.createDataFrame([(1, 0, text), (2, 0, text + " at x.com")], "call_id long, seq long, text string")
    assert {r.call_id for r in pii.pii_spans(df, ["spoken_email"]).collect()} <= {2}
    assert pii.pii_spans(df, ["person_run"]).count() == 2


def test_redactions_in_the_new_text(spark):
    text = "mail a@b.com or c@d.org, then a@b.com \U0001f600 again"
    df = spark.createDataFrame([(1, 0, text), (1, 1, "c@d.org"), (2, 0, "nothing"), (2, 1, None)], "call_id long, seq long, text string")
    out = {(r.call_id, r.seq): r for r in pii.redact(df, ["email"]).collect()}
    assert out[1, 0].text == "mail <EMAIL_1> or <EMAIL_2>, then <EMAIL_1> \U0001f600 again" and out[1, 1].text == "<EMAIL_2>"
    assert all(out[1, 0].text[r.start : r.end] == r.placeholder for r in out[1, 0].redactions) and out[1, 0].n_redactions == 3
    assert out[2, 0].text == "nothing" and out[2, 1].text is None and out[2, 0].redactions == []


def test_each_detector_runs_once(spark):
    df = spark.createDataFrame([(1, 0, "x")], "call_id long, seq long, text string")
    plan = pii.detect_pii(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(pii.DETECTORS)


def test_fact_rows(spark):
    span = "struct<seq:int,start_ms:int,end_ms:int,speaker:string,quote:string>"
    lat = "struct<asr_ms:double,redact_ms:double,ingest_ms:double,queue_ms:double,analyze_ms:double,llm_ms:double,segment_to_signal_ms:double>"
    schema = f"signal_id string, call_id string, agent_id string, signal_type string, label string, severity string, policy_id string, confidence float, rationale string, emitted_at timestamp, window_start_ms int, window_end_ms int, evidence array<{span}>, latency {lat}, model_name string, prompt_version string, traceparent string"
    import datetime as dt

    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    rows = [
        ("s1", "c", None, "intent", "x", "low", None, 0.5, "r", at, 0, 9, [(3, 10, 20, "agent", "q")], (1.0, None, None, None, 2.0, None, 30.0), "m", "p", "00-abc-7-01"),
        ("s2", "c", "a2", "intent", "y", "low", "P1", 0.5, "r", at, 0, 9, None, (None,) * 7, "m", "p", None),
    ]
    signals = spark.createDataFrame(rows, schema)
    flat = {r.signal_id: r for r in facts.to_signal_rows(signals, F.lit("a1")).collect()}
    assert (flat["s1"].agent_id, flat["s1"].policy_id, flat["s1"].trace_id, flat["s1"].evidence_seq, flat["s1"].evidence_quote) == ("a1", "", "abc", [3], ["q"])
    assert (flat["s2"].agent_id, flat["s2"].trace_id, flat["s2"].evidence_seq, flat["s2"].latency_asr_ms) == ("a2", "", [], None)
    late = {(r.seq, r.stage, r.duration_ms) for r in facts.to_latency_rows(signals).collect()}
    assert late == {(3, "asr", 1.0), (3, "analyze", 2.0), (3, "e2e", 30.0)}
    back = {r.signal_id: r for r in facts.evidence_structs(facts.to_signal_rows(signals)).collect()}
    assert [tuple(e) for e in back["s1"].evidence] == [(3, 10, 20, "agent", "q")] and back["s2"].evidence == [] and back["s1"].policy_id is None
    schema = "call_id string, agent_id string, primary_intent string, secondary_intents array<string>, resolution string, escalated boolean, summary string, customer_sentiment_start double, customer_sentiment_end double, compliance_violations array<string>, disclosures_given array<string>, action_items array<struct<description:string,owner:string>>, emitted_at timestamp, model_name string, prompt_version string, traceparent string"
    summary = spark.createDataFrame([("c", None, "i", None, "resolved", True, "s", -0.5, 0.5, ["P1", "P2"], None, [("do it", "agent")], at, "m", "p", "bad")], schema)
    bare = facts.to_summary_rows(summary).first()
    assert (bare.turn_count, bare.duration_ms, bare.redaction_count, bare.started_at, bare.ended_at) == (0, 0, 0, at, at)
    assert (bare.sentiment_delta, bare.violation_count, bare.ended_date, bare.escalated, bare.secondary_intents, bare.action_items) == (1.0, 2, at.date(), 1, [], ["do it"])
    full = facts.to_summary_rows(summary, spark.createDataFrame([("c", 7, 900)], "call_id string, turn_count int, duration_ms int")).first()
    assert (full.turn_count, full.duration_ms, full.redaction_count) == (7, 900, 0)


def test_rollup_keeps_labels_and_nulls(spark):
    rows = [("a", "t", "L1", "low", "P", 0.5, None, "c1", "2024-01-01 10:05:00"), ("a", "t", "L2", "low", "P", 0.7, 10.0, "c1", "2024-01-01 10:06:00"), ("a", "t", "L2", "low", "P", 0.7, 30.0, "c2", "2024-01-01 11:06:00")]
    df = spark.createDataFrame(rows, "agent_id string, signal_type string, label string, severity string, policy_id string, confidence double, duration_ms double, call_id string, emitted_at string")
    df = df.withColumn("emitted_at", F.to_timestamp("emitted_at"))
    hourly = marts.rollup_signals_hourly(df)
    assert hourly.count() == 3
    merged = {r.label: (r.events, r.calls, r.p95_ms) for r in marts.merge_signals(marts.merge_rollup(hourly, ["label"], "day"), ["label"]).where("label = 'L2'").collect()}
    assert merged == {"L2": (2, 2, 30.0)}
    zero = marts.rollup_signals_hourly(df, null_as_zero=True)
    assert marts.merge_signals(zero, ["label"]).where("label = 'L1'").first().p95_ms == 0.0


def test_label_sets_runs_and_moods(spark):
    pairs = spark.createDataFrame([(["a", "b", "a"], ["b", "c"]), (None, ["c"]), (["a"], [])], "e array<string>, a array<string>")
    whole = quality.label_set_prf(pairs, "e", "a").first()
    assert (whole.tp, whole.fp, whole.fn, whole.precision, whole.recall) == (1, 2, 2, 0.333333, 0.333333)
    each = {r.label: (r.tp, r.fp, r.fn) for r in quality.label_set_prf(pairs, "e", "a", per_label=True).collect()}
    assert each == {"a": (0, 0, 2), "b": (1, 0, 0), "c": (0, 2, 0)}
    table = lambda *rows: spark.createDataFrame(rows, "metric string, value double")
    before = table(("leak_rate", 0.0), ("redaction_recall", 0.98), ("intent_accuracy", 0.8), ("live_p95_ms", 5.0), ("redaction_f2", 0.9), ("odd", 1.0))
    after = table(("leak_rate", 0.01), ("redaction_recall", 0.99), ("intent_accuracy", 0.796), ("live_p95_ms", 7.0), ("type_accuracy", 0.9), ("odd", 0.0))
    out = quality.compare_runs(before, after)
    assert {r.metric: (r.change, r.fails) for r in out.collect()} == {"leak_rate": ("worse", True), "redaction_recall": ("better", False), "intent_accuracy": ("same", False), "live_p95_ms": ("worse", False)}
    assert tuple(quality.run_verdict(out).first()) == (4, 1, 2, False)
    moods = spark.createDataFrame([(0.0, 0.5, 0.0, 0.2), (0.0, -0.1, 0.0, 0.0), (0.0, -0.1, 0.5, 0.0)], "sentiment_start double, sentiment_end double, gold_sentiment_start double, gold_sentiment_end double")
    assert tuple(quality.sentiment_error(moods).first()) == (3, 0.666667, 0.266667)
    labelled = quality.join_labels(spark.createDataFrame([(1, "x")], "call_id long, intent string"), spark.createDataFrame([(1, "y", True)], "call_id long, intent string, escalated boolean"))
    assert labelled.first().asDict() == {"call_id": 1, "intent": "x", "gold_intent": "y", "escalated": True}


def test_activity_of_calls(spark):
    seen = spark.createDataFrame([("c", 1, True, 1), ("c", 1, True, 2), ("c", 1, False, 3), ("c", 4, True, 0)], "call_id string, seq int, is_final boolean, t int").withColumn("emitted_at", F.timestamp_seconds("t"))
    row = streaming.call_activity(seen).first()
    assert (row.segments, row.duplicates, row.last_seq) == (4, 1, 4)


def test_sketched_quantiles_are_near_the_exact(spark):
    df = spark.range(20_000).selectExpr("'s' as stage", "cast(id as double) as duration_ms", "timestamp_seconds(id % 60) as emitted_at")
    exact, sketched = marts.latency_percentiles(df, 500).first(), marts.latency_percentiles(df, 500, exact=False).first()
    assert all(abs(exact[c] - sketched[c]) < 600 for c in ("p50_ms", "p95_ms", "p99_ms")) and exact.samples == sketched.samples
