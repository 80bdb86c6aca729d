"""Registered queries over fact rows, label sets, run comparisons and operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope import streaming
from callscope.operators import contracts, facts, marts, pii, quality
from callscope.sources import insight_rows, to_kafka_rows
from callscope.testdata import PLANTED_SQL, SIGNALS_SQL, SUMMARIES_SQL, documents, planted, signals, summaries, table


def _insights(s, d):
    """Events as signals of the wire: evidence and latencies nested, some ids missing."""
    span = "struct(cast(signal_id % 7 as int) as seq, cast(signal_id % 90 as int) as start_ms, cast(signal_id % 90 + 9 as int) as end_ms, 'agent' as speaker, concat('q', signal_id % 11) as quote)"
    return signals(s, d).selectExpr(
        "signal_id", "call_id", "if(signal_id % 3 = 0, null, cast(agent_id as string)) as agent_id", "signal_type", "label", "severity", "if(signal_id % 4 = 0, null, policy_id) as policy_id",
        "confidence", "concat('because ', signal_type) as rationale", "emitted_at", "cast(signal_id % 100 as int) as window_start_ms", "cast(signal_id % 100 + 10 as int) as window_end_ms",
        f"case when signal_id % 5 = 0 then null when signal_id % 2 = 0 then array({span}, {span}) else array({span}) end as evidence",
        "struct(if(signal_id % 2 = 0, duration_ms, null) as asr_ms, cast(null as double) as redact_ms, cast(null as double) as ingest_ms, cast(null as double) as queue_ms, 1.5D as analyze_ms, cast(null as double) as llm_ms, duration_ms as segment_to_signal_ms) as latency",
        "'rules' as model_name", "'v1' as prompt_version", "if(signal_id % 6 = 0, 'bad', concat('00-', md5(cast(signal_id as string)), '-77-01')) as traceparent",
    )


def _wire(s, d):
    """Envelopes as JSON: one of a signal (of every 4th event it is of no known kind, of every 7th of another version), and one a call's summary."""
    signal = F.struct(
        F.col("signal_id").cast("string").alias("signal_id"), F.col("call_id").cast("string").alias("call_id"), F.col("signal_type").alias("type"), "label", "severity", "confidence", "rationale", "evidence",
        "policy_id", "window_start_ms", "window_end_ms", F.col("emitted_at").cast("string").alias("emitted_at"), "agent_id", "latency", "model_name", "prompt_version", "traceparent",
    )
    live = _insights(s, d).select(F.to_json(F.struct(
        F.when(F.col("signal_id") % 7 > 0, "1.4").otherwise("2.0").alias("schema_version"), F.when(F.col("signal_id") % 4 > 0, "live").otherwise("other").alias("kind"),
        F.col("call_id").cast("string").alias("call_id"), F.lit("E1").alias("agent_id"), F.array(signal).alias("signals"),
    )).alias("value"))
    ended = summaries(s, d).selectExpr("""to_json(struct('post_call' as kind, cast(call_id as string) as call_id, cast(agent_id as string) as agent_id, cast(ended_at as string) as emitted_at, struct(
     cast(call_id as string) as call_id, 'It ended.' as summary, resolution, primary_intent, array('other') as secondary_intents, array(struct(concat('call ', call_id) as description, 'agent' as owner)) as action_items,
     sentiment_start as customer_sentiment_start, sentiment_end as customer_sentiment_end, escalated = 1 as escalated, array_repeat('P1', violation_count) as compliance_violations, 'm' as model_name, 'v2' as prompt_version) as summary)) as value""")
    return live.unionByName(ended)


def _sunk(s, d, name: str):
    counts = summaries(s, d).select(F.col("call_id").cast("string").alias("call_id"), "turn_count")
    return insight_rows(_wire(s, d), counts)[name]


def _rows(s, d):
    return facts.to_signal_rows(_insights(s, d), F.lit("E1"))


def _flat(df, *arrays: str):
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in arrays})


def _sets(s, d):
    """Label lists of each call from two halves of its events; the calls' days are the moods."""
    rows = signals(s, d)
    half = lambda k: F.sort_array(F.collect_set(F.when(F.col("signal_id") % 3 != k, F.col("policy_id"))))
    mood = lambda k: (F.sum(F.when(F.col("signal_id") % 3 == k, 1).otherwise(0)) / 10).alias
    return rows.groupBy("call_id").agg(
        half(0).alias("expected"), half(1).alias("actual"), mood(0)("sentiment_start"), mood(1)("sentiment_end"), mood(1)("gold_sentiment_start"), mood(2)("gold_sentiment_end")
    )


SETS_SQL = f"""(select call_id, list(distinct policy_id) filter (signal_id % 3 <> 0) as expected, list(distinct policy_id) filter (signal_id % 3 <> 1) as actual,
 count(*) filter (signal_id % 3 = 0) / 10 as sentiment_start, count(*) filter (signal_id % 3 = 1) / 10 as sentiment_end, count(*) filter (signal_id % 3 = 1) / 10 as gold_sentiment_start,
 count(*) filter (signal_id % 3 = 2) / 10 as gold_sentiment_end from {SIGNALS_SQL} group by 1)"""


def _run(s, d, k: int):
    """A metric table by agent: shares of the agent's events."""
    rows = signals(s, d).where(F.col("signal_id") % 2 == k)
    share = lambda t: F.round(F.avg((F.col("signal_type") == t).cast("double")), 6)
    wide = rows.groupBy("agent_id").agg(share("click").alias("leak_rate"), share("view").alias("redaction_recall"), share("purchase").alias("intent_accuracy"), F.round(F.avg("duration_ms"), 6).alias("live_p95_ms"))
    return wide.unpivot("agent_id", ["leak_rate", "redaction_recall", "intent_accuracy", "live_p95_ms"], "metric", "value")


def _run_sql(k: int) -> str:
    share = lambda t, n: f"round(avg((signal_type = '{t}')::int), 6) as {n}"
    wide = f"select agent_id, {share('click', 'leak_rate')}, {share('view', 'redaction_recall')}, {share('purchase', 'intent_accuracy')}, round(avg(duration_ms), 6) as live_p95_ms from {SIGNALS_SQL} where signal_id % 2 = {k} group by 1"
    return f"(unpivot ({wide}) on leak_rate, redaction_recall, intent_accuracy, live_p95_ms into name metric value value)"


def _compared(s, d):
    return quality.compare_runs(_run(s, d, 0), _run(s, d, 1), by=["agent_id"])


def _spans(s, d):
    found = pii.pii_spans(documents(s, d), ["email", "phone", "ssn"])
    return found.select("call_id", "type", F.col("detector").alias("surface_form"))


def _ops(s, d):
    """Events as counters of a pipeline."""
    names = ["segment", "final", "redaction", "hold", "rejected", "duplicate", "dropped_final", "row_dropped", "summary", "summary_failed", "claim", "claim_dropped", "tokens", "lag"]
    at = (F.col("signal_id") % len(names)).cast("int") + 1
    return signals(s, d).select(F.element_at(F.array(*map(F.lit, names)), at).alias("event"), (F.col("signal_id") % 9).alias("n"), "emitted_at")


OPS_SQL = f"""(select (['segment', 'final', 'redaction', 'hold', 'rejected', 'duplicate', 'dropped_final', 'row_dropped', 'summary', 'summary_failed', 'claim', 'claim_dropped', 'tokens', 'lag'])[signal_id % 14 + 1] as event,
 signal_id % 9 as n, emitted_at from {SIGNALS_SQL})"""


def _busy_ops(s, d):
    """A month's counters as those of a day, with lags in the thousands; in every fourth hour nothing is redacted and much is emitted."""
    at = F.expr("timestamp_micros(unix_micros(timestamp'2024-01-01') + (unix_micros(cast(emitted_at as timestamp)) - unix_micros(timestamp'2024-01-01')) div 30)")
    rows = _ops(s, d).withColumn("emitted_at", at)
    quiet = F.hour("emitted_at") % 4 == 0
    event = F.when(quiet & (F.col("event") == "redaction"), "segment").otherwise(F.col("event"))
    return rows.select(event.alias("event"), F.when(F.col("event") == "lag", F.col("n") * 1500).when(F.col("event") == "segment", F.col("n") * 20).otherwise(F.col("n")).alias("n"), "emitted_at")


def _busy_latency(s, d):
    """Events as durations in ms of a day's signals."""
    at = F.expr("timestamp_micros(unix_micros(timestamp'2024-01-01') + (unix_micros(cast(emitted_at as timestamp)) - unix_micros(timestamp'2024-01-01')) div 30)")
    return signals(s, d).select((F.col("duration_ms") * 14).alias("duration_ms"), at.alias("emitted_at"))


BUSY_LATENCY_SQL = f"(select duration_ms * 14 as duration_ms, make_timestamp(1704067200000000 + (epoch_us(emitted_at) - 1704067200000000) // 30) as emitted_at from {SIGNALS_SQL})"
#: The same, and each alert's condition as the rules file has it: range in minutes, value, condition, minutes that it must hold.
BUSY_OPS_SQL = f"""(select case when event = 'redaction' and hour(moment) % 4 = 0 then 'segment' else event end as event,
 case event when 'lag' then n * 1500 when 'segment' then n * 20 else n end as n, moment as emitted_at
 from (select event, n, make_timestamp(1704067200000000 + (epoch_us(emitted_at) - 1704067200000000) // 30) as moment from {OPS_SQL}))"""
ALERT_RULES = {
    "final_segments_shed": (5, "sum(n) filter (event = 'dropped_final')", "v > 0", 0),
    "rows_dropped": (10, "sum(n) filter (event = 'row_dropped')", "v > 0", 0),
    "summaries_failing": (15, "sum(n) filter (event = 'summary_failed') / greatest(coalesce(sum(n) filter (event = 'summary'), 0), 1)", "v > 0.1", 10),
    "hold_churn": (5, "coalesce(sum(n) filter (event = 'hold'), 0) / nullif(coalesce(sum(n) filter (event = 'final'), 0), 0)", "hold > 0.5 * final", 10),
    "consumer_lag": (5, "arg_max(n, emitted_at) filter (event = 'lag')", "v > 5000", 5),
    "redaction_collapsed": (15, "sum(n) filter (event = 'segment') / 900", "redacted = 0 and v > 0.1", 15),
}


def slid_sql(rows_sql: str, minutes: int) -> str:
    """Rows at every full minute (``slot``) whose range of so many minutes holds them."""
    return f"(select *, time_bucket(interval '1 minute', emitted_at) + k * interval '1 minute' as slot from (select *, unnest(generate_series(1, {minutes})) as k from {rows_sql}))"


def fired_sql(evaluated: str) -> str:
    """(alert, since, fired_at, value) of breached evaluations (alert, slot, v, holds)."""
    return f"""select alert, since, min(slot) as fired_at, round(arg_min(coalesce(v, 1e300), slot), 6) as value from (select *, min(slot) over (partition by alert, run) as since
 from (select *, slot - row_number() over (partition by alert order by slot) * interval '1 minute' as run from ({evaluated})))
 where slot >= since + holds * interval '1 minute' group by alert, run, since"""


def alerts_sql(events_sql: str) -> str:
    count = lambda e: f"coalesce(sum(n) filter (event = '{e}'), 0)"
    return fired_sql(" union all ".join(
        f"""select '{alert}' as alert, slot, v, {holds} as holds from (select slot, ({value})::double as v, {count('hold')} as hold, {count('final')} as final, {count('redaction')} as redacted
 from {slid_sql(events_sql, minutes)} group by slot) where {test}"""
        for alert, (minutes, value, test, holds) in ALERT_RULES.items()
    ))


def _placeholders(s, d):
    return pii.assign_placeholders(pii.detect_pii(documents(s, d), ["email"])).select("call_id", "start", "end", "placeholder")


#: Kinds of personal data that are planted, and the two that are met without.
PLANTED_KINDS = ("ssn", "dob_numeric", "dob_wordy", "account_labelled", "address", "person_trigger", "phone", "email", "spoken_email")


def queries() -> dict:
    kinds = {f"planted_{k}": lambda s, d, k=k: pii.pii_spans(planted(s, d), [k]) for k in PLANTED_KINDS}
    return base_queries() | kinds


def base_queries() -> dict:
    evidence = [f"evidence_{c}" for c in facts.EVIDENCE]
    return {
        "signal_rows": lambda s, d: _flat(_rows(s, d), *evidence).drop("emitted_at", "rationale", "model_name", "prompt_version"),
        "wire_reasons": lambda s, d: contracts.validate_signals(
            _insights(s, d).withColumn("severity", F.expr("if(signal_id % 13 = 0, 'dire', severity)")).withColumn("rationale", F.expr("if(signal_id % 17 = 0, repeat('x', 1001), rationale)")).drop("window_end_ms").withColumn("window_end_ms", F.lit(200))
        ).select("signal_id", F.array_join("reasons", ",").alias("reasons")),
        "latency_rows": lambda s, d: facts.to_latency_rows(_insights(s, d), F.lit("E1")),
        "sink_signals": lambda s, d: _flat(_sunk(s, d, "signals"), *evidence).drop("rationale", "model_name", "prompt_version"),
        "sink_latencies": lambda s, d: _sunk(s, d, "latencies"),
        "sink_summaries": lambda s, d: _flat(_sunk(s, d, "summaries"), "secondary_intents", "compliance_violations", "disclosures_given", "action_items", "action_item_owners").withColumn("sentiment_delta", F.round("sentiment_delta", 6)),
        "evidence_structs": lambda s, d: facts.evidence_structs(_rows(s, d)).select("signal_id", "policy_id", F.explode("evidence").alias("e")).groupBy("signal_id", "policy_id").agg(
            F.count(F.lit(1)).alias("n"), F.max("e.seq").alias("seq"), F.max("e.quote").alias("quote")
        ),
        "label_set_prf": lambda s, d: quality.label_set_prf(_sets(s, d), "expected", "actual"),
        "label_prf_each": lambda s, d: quality.label_set_prf(_sets(s, d), "expected", "actual", per_label=True),
        "sentiment_error": lambda s, d: quality.sentiment_error(_sets(s, d)),
        "compare_runs": _compared,
        "run_verdict": lambda s, d: quality.run_verdict(_compared(s, d), ["agent_id"]),
        "corpus_profile": lambda s, d: quality.corpus_profile(table(s, d, "documents").select(F.col("lang").alias("category")), table(s, d, "conversations"), _spans(s, d)),
        "join_labels": lambda s, d: quality.join_labels(
            documents(s, d).select("call_id", F.length("text").alias("quality")), table(s, d, "labels").withColumnRenamed("doc_id", "call_id")
        ),
        "merge_rollup": lambda s, d: marts.merge_rollup(marts.rollup_signals_hourly(signals(s, d)), ["label", "severity"], "day").select("hour", "label", "severity", "events", F.round("confidence_sum", 4).alias("confidence_sum")),
        "exact_rollup": lambda s, d: marts.exact_rollup(signals(s, d), ["label"]),
        "compatible": lambda s, d: contracts.compatible(signals(s, d).withColumn("schema_version", F.expr("element_at(array('1.0', '2.1', '1.9', null, '11.0'), cast(signal_id % 5 as int) + 1)"))).select("signal_id", "schema_version"),
        "drop_reasons": lambda s, d: contracts.drop_reasons(_insights(s, d)).groupBy(F.coalesce("dropped", F.lit("kept")).alias("dropped")).agg(F.count(F.lit(1)).alias("n")),
        "with_trace_id": lambda s, d: contracts.with_trace_id(_insights(s, d)).select("signal_id", "trace_id"),
        "with_elapsed_ms": lambda s, d: contracts.with_elapsed_ms(signals(s, d).withColumn("later", F.expr("emitted_at + make_dt_interval(0, 0, 0, signal_id % 5000 - 500)")), "emitted_at", "later").select("signal_id", "elapsed_ms"),
        "with_lenient_ts": lambda s, d: contracts.with_lenient_ts(signals(s, d).withColumn("at", F.expr("if(signal_id % 4 = 0, 'soon', '2024-01-05 10:00:00')")), "at", "emitted_at").select("signal_id", "at"),
        "redactions_by_call": lambda s, d: pii.redactions_by_call(documents(s, d), pii.pii_spans(documents(s, d), ["email"])),
        "placeholders_email": _placeholders,
        "event_feed": lambda s, d: marts.replay_tail(marts.event_feed(signals(s, d).withColumn("seq", F.col("signal_id") % 9), signals(s, d), summaries(s, d)), 400).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("emitted_at").alias("last")),
        "kafka_rows": lambda s, d: to_kafka_rows(signals(s, d).select("call_id", "signal_id", "label")),
        "ops_alerts": lambda s, d: streaming.ops_alerts(_busy_ops(s, d)).withColumn("value", F.coalesce("value", F.lit(1e300))),
        "latency_alerts": lambda s, d: streaming.latency_alerts(_busy_latency(s, d)),
        "ops_panel": lambda s, d: streaming.ops_panel(_ops(s, d), "1 hour"),
        "late_rows": lambda s, d: streaming.late_rows(signals(s, d).withColumn("arrived", F.col("signal_id")), "6 hours").groupBy("call_id").agg(F.count_if("is_late").alias("late"), F.count(F.lit(1)).alias("n")),
    }


def oracle_sql() -> dict:
    from callscope import plans

    kinds = {f"planted_{k}": plans.spans_sql(k, pii.DETECTORS[k][2], PLANTED_SQL) for k in PLANTED_KINDS}
    return base_sql() | kinds


def base_sql() -> dict:
    from callscope import plans

    own = plans.base_sql()
    sg = SIGNALS_SQL
    n_spans = "case when signal_id % 5 = 0 then 0 when signal_id % 2 = 0 then 2 else 1 end"
    rep = lambda v: f"array_to_string(list_transform(range({n_spans}), lambda i: {v}), ',')"
    agent = "case when signal_id % 3 = 0 then 'E1' else agent_id::varchar end"
    policy = "case when signal_id % 4 = 0 then '' else policy_id end"
    trace = "case when signal_id % 6 = 0 then '' else md5(signal_id::varchar) end"
    prf = "round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f"
    ratio = "case when tp + fp = 0 then 0 else tp / (tp + fp) end as p, case when tp + fn = 0 then 0 else tp / (tp + fn) end as r"
    defs = ", ".join(f"('{m}', {str(h).lower()}, {str(g).lower()}, {t}::double)" for m, h, g, t in quality.METRICS)
    compared = f"""select b.agent_id, b.metric, b.value as before, a.value as after, round(a.value - b.value, 6) as delta,
 case when abs(a.value - b.value) <= tolerance then 'same' when (a.value > b.value) = higher then 'better' else 'worse' end as change,
 gate and abs(a.value - b.value) > tolerance and (a.value > b.value) <> higher as fails
 from {_run_sql(0)} b join {_run_sql(1)} a using (agent_id, metric) join (values {defs}) m(metric, higher, gate, tolerance) on m.metric = b.metric"""
    spans = " union all ".join(f"select type, detector from ({own[f'pii_{k}']})" for k in ("email", "phone", "ssn"))
    total = lambda e: f"coalesce(sum(n) filter (event = '{e}'), 0)"
    slot = lambda w: f"time_bucket(interval '{w}', emitted_at)"
    panel = " union all ".join(f"select {slot('1 hour')} as window_start, '{r}' as ratio, round({total(a)} / greatest({total(b)}, 1), 6) as value from {OPS_SQL} group by 1" for r, (a, b) in streaming.RATIOS.items())
    sums = "cast(sum(len(list_intersect(expected, actual))) as bigint) as tp, cast(sum(len(list_filter(actual, lambda x: not list_contains(coalesce(expected, []), x)))) as bigint) as fp, cast(sum(len(list_filter(expected, lambda x: not list_contains(coalesce(actual, []), x)))) as bigint) as fn"
    return {
        "signal_rows": f"""select signal_id, call_id, {agent} as agent_id, signal_type, label, severity, {policy} as policy_id, confidence, cast(signal_id % 100 as int) as window_start_ms, cast(signal_id % 100 + 10 as int) as window_end_ms,
 {rep('signal_id % 7')} as evidence_seq, {rep('signal_id % 90')} as evidence_start_ms, {rep('signal_id % 90 + 9')} as evidence_end_ms, {rep("'agent'")} as evidence_speaker, {rep("'q' || (signal_id % 11)")} as evidence_quote,
 case when signal_id % 2 = 0 then duration_ms end as latency_asr_ms, null::double as latency_redact_ms, null::double as latency_ingest_ms, null::double as latency_queue_ms, 1.5::double as latency_analyze_ms, null::double as latency_llm_ms,
 duration_ms as latency_segment_to_signal_ms, {trace} as trace_id from {sg}""",
        "wire_reasons": f"""select signal_id, concat_ws(',', case when not coalesce(confidence between 0 and 1, false) then 'confidence' end, case when signal_id % 5 = 0 then 'evidence' end, 'signal_type',
 case when signal_id % 13 = 0 then 'severity' end, case when signal_id % 17 = 0 then 'rationale_length' end) as reasons from {sg}""",
        "latency_rows": f"""select call_id, case when signal_id % 5 = 0 then 0 else cast(signal_id % 7 as int) end as seq, {agent} as agent_id, stage, v as duration_ms, 1 as is_final, emitted_at
 from (select *, 'asr' as stage, case when signal_id % 2 = 0 then duration_ms end as v from {sg} union all select *, 'analyze', 1.5 from {sg} union all select *, 'e2e', duration_ms from {sg}) where v is not null""",
        "sink_signals": f"""select signal_id::varchar as signal_id, call_id::varchar as call_id, {agent} as agent_id, signal_type, label, severity, {policy} as policy_id, confidence, emitted_at, cast(signal_id % 100 as int) as window_start_ms,
 cast(signal_id % 100 + 10 as int) as window_end_ms, {rep('signal_id % 7')} as evidence_seq, {rep('signal_id % 90')} as evidence_start_ms, {rep('signal_id % 90 + 9')} as evidence_end_ms, {rep("'agent'")} as evidence_speaker,
 {rep("'q' || (signal_id % 11)")} as evidence_quote, case when signal_id % 2 = 0 then duration_ms end as latency_asr_ms, null::double as latency_redact_ms, null::double as latency_ingest_ms, null::double as latency_queue_ms,
 1.5::double as latency_analyze_ms, null::double as latency_llm_ms, duration_ms as latency_segment_to_signal_ms, {trace} as trace_id from {sg} where signal_id % 4 > 0 and signal_id % 7 > 0""",
        "sink_latencies": f"""select call_id::varchar as call_id, case when signal_id % 5 = 0 then 0 else cast(signal_id % 7 as int) end as seq, {agent} as agent_id, stage, v as duration_ms, 1 as is_final, emitted_at
 from (select *, 'asr' as stage, case when signal_id % 2 = 0 then duration_ms end as v from {sg} union all select *, 'analyze', 1.5 from {sg} union all select *, 'e2e', duration_ms from {sg})
 where v is not null and signal_id % 4 > 0 and signal_id % 7 > 0""",
        "sink_summaries": f"""select call_id::varchar as call_id, agent_id::varchar as agent_id, primary_intent, 'other' as secondary_intents, resolution, escalated, 'It ended.' as summary, sentiment_start, sentiment_end,
 array_to_string(list_transform(range(violation_count), lambda i: 'P1'), ',') as compliance_violations, '' as disclosures_given, 'call ' || call_id as action_items, 'agent' as action_item_owners, turn_count::int as turn_count,
 0 as duration_ms, 0 as redaction_count, ended_at as started_at, ended_at, 'm' as model_name, 'v2' as prompt_version, '' as trace_id, round(sentiment_end - sentiment_start, 6) as sentiment_delta, violation_count, ended_date from {SUMMARIES_SQL}""",
        "evidence_structs": f"select signal_id, nullif({policy}, '') as policy_id, cast({n_spans} as bigint) as n, cast(signal_id % 7 as int) as seq, 'q' || (signal_id % 11) as quote from {sg} where signal_id % 5 > 0",
        "label_set_prf": f"select tp, fp, fn, {prf} from (select *, {ratio} from (select {sums} from {SETS_SQL}))",
        "label_prf_each": f"""select label, tp, fp, fn, {prf} from (select *, {ratio} from (select label, count(*) filter (e and a) as tp, count(*) filter (a and not e) as fp, count(*) filter (e and not a) as fn
 from (select l as label, list_contains(coalesce(expected, []), l) as e, list_contains(coalesce(actual, []), l) as a from (select *, unnest(list_distinct(list_concat(coalesce(expected, []), coalesce(actual, [])))) as l from {SETS_SQL})) group by 1))""",
        "sentiment_error": f"""select count(*) as n, round(avg(((w >= 0) = (g >= 0))::int), 6) as direction_accuracy, round(avg(abs(w - g)), 6) as delta_error
 from (select gold_sentiment_end - gold_sentiment_start as w, sentiment_end - sentiment_start as g from {SETS_SQL})""",
        "compare_runs": compared,
        "run_verdict": f"select agent_id, count(*) as metrics, count(*) filter (change = 'better') as better, count(*) filter (change = 'worse') as worse, not bool_or(fails) as passed from ({compared}) group by 1",
        "corpus_profile": f"""select 'category' as what, lang as name, count(*) as n from documents group by all union all select 'type', type, count(*) from ({spans}) group by all
 union all select 'surface_form', detector, count(*) from ({spans}) group by all union all select 'calls', 'all', count(*) from documents union all select 'turns', 'all', count(*) from conversations union all select 'spans', 'all', count(*) from ({spans})""",
        "join_labels": "select doc_id as call_id, length(text)::int as quality, l.quality as gold_quality, l.toxic from documents join labels l using (doc_id)",
        "merge_rollup": f"select date_trunc('day', emitted_at) as hour, label, severity, count(*) as events, round(sum(confidence), 4) as confidence_sum from {sg} group by 1, 2, 3",
        "exact_rollup": f"select date_trunc('day', emitted_at) as hour, label, count(*) as events, round(avg(confidence), 4) as avg_confidence, count(distinct call_id) as calls from {sg} group by 1, 2",
        "compatible": f"select signal_id, case signal_id % 5 when 0 then '1.0' when 2 then '1.9' end as schema_version from {sg} where signal_id % 5 in (0, 2, 3)",
        "drop_reasons": f"select case when not coalesce(confidence >= 0.35, false) then 'confidence' when signal_id % 5 = 0 then 'evidence' else 'kept' end as dropped, count(*) as n from {sg} group by 1",
        "with_trace_id": f"select signal_id, {trace} as trace_id from {sg}",
        "with_elapsed_ms": f"select signal_id, case when signal_id % 5000 - 500 between 0 and 3600 then (signal_id % 5000 - 500) * 1000 end as elapsed_ms from {sg}",
        "with_lenient_ts": f"select signal_id, case when signal_id % 4 = 0 then emitted_at else timestamp '2024-01-05 10:00:00' end as at from {sg}",
        "redactions_by_call": f"select doc_id as call_id, count(distinct doc_id) as texts, count(start) as redactions, count(distinct case when start is not null then 1 end) as redacted_texts from documents left join ({own['pii_email']}) s on s.call_id = doc_id group by 1",
        "placeholders_email": f"""with s as (select call_id, start, "end", lower(substring(text, start + 1, "end" - start)) as value from ({own['pii_email']}) join documents on doc_id = call_id),
 k as (select *, case when length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4 then regexp_replace(value, '[^0-9]', '', 'g') else value end as key from s),
 f as (select *, min(start) over (partition by call_id, key) as first from k)
 select call_id, start, "end", '<EMAIL_' || dense_rank() over (partition by call_id order by first) || '>' as placeholder from f""",
        "event_feed": f"""select kind, count(*) as n, max(emitted_at) as last from (select * from (select 'segment' as kind, (signal_id % 9)::varchar as id, emitted_at::timestamp as emitted_at from {sg}
 union all select 'signal', signal_id::varchar, emitted_at from {sg} union all select 'summary', call_id::varchar, ended_at from {SUMMARIES_SQL}) order by emitted_at desc, id desc limit 400) group by 1""",
        "kafka_rows": f"""select call_id::varchar as key, '{{"call_id":' || call_id || ',"signal_id":' || signal_id || ',"label":"' || label || '"}}' as value from {sg}""",
        "ops_alerts": alerts_sql(BUSY_OPS_SQL),
        "latency_alerts": fired_sql(f"select 'signal_latency' as alert, slot, v, 3 as holds from (select slot, quantile_cont(duration_ms, 0.95) as v from {slid_sql(BUSY_LATENCY_SQL, 5)} group by slot) where v > 2000"),
        "ops_panel": panel,
        "late_rows": f"""select call_id, count(*) filter (emitted_at < seen - interval 6 hours) as late, count(*) as n from (select *, max(emitted_at) over (partition by call_id order by signal_id rows between unbounded preceding and 1 preceding) as seen from {sg}) group by 1""",
    }
