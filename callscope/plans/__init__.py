"""Registered queries over the conversation operators, with their SQL.

The demo word lists hold words that the invented prose of the test tables has.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from callscope import streaming
from callscope.functions.digits import CONTEXT, NEAR
from callscope.operators import contracts, conversation, marts, pii, quality
from callscope.testdata import SIGNALS_SQL, SUMMARIES_SQL, TURNS_SQL, documents, signals, summaries, table, turns

WEIGHTS = {"and": 0.5, "with": 0.4, "was": -0.5, "for": -0.3}
NEGATIONS, INTENSIFIERS = ["no", "not"], {"the": 1.4}
PATTERNS = [(r"(?i)\bthat\b", 0.6, "that"), (r"(?i)\bof the\b", 0.9, "of_the")]
PHRASES = [("P1", "that"), ("P2", "with"), ("P3", "the th")]
REQUIRED = [("P1", "that", 3), ("P2", "with", None), ("P3", "of", 2)]
INTENTS = {"the_topic": {"the": 1.0, "of": 0.5}, "in_topic": {"in ": 1.0, "to": 0.75}}
KIND = "error"


def _sentiment(s, d):
    return conversation.score_sentiment(turns(s, d), WEIGHTS, NEGATIONS, INTENSIFIERS)


def _scores(s, d):
    return conversation.score_intents(turns(s, d), INTENTS)


def spread(df):
    """The detectors take many times as long as reading: a table of few files is dealt to all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _gold(s, d):
    """The labels beside a plain rule's prediction."""
    rule = F.expr("cast(length(text) >= 400 as int)")
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", rule.alias("predicted")), "doc_id")


def _segments(s, d):
    """Events as segments, with the faults that the contract finds."""
    return table(s, d, "events").select(
        F.col("user_id").cast("string").alias("call_id"), F.expr("cast(event_id % 97 as int) - 1").alias("seq"), F.expr("if(event_type = 'click', 'agent', if(event_type = 'view', 'customer', event_type))").alias("speaker"),
        F.col("event_type").alias("text"), F.lit(True).alias("is_final"), F.expr("cast(event_id % 50 as int)").alias("start_ms"), F.expr("cast(event_id % 60 as int)").alias("end_ms"), (F.col("value") / 400).alias("asr_confidence"), F.col("ts").alias("emitted_at"), "event_id",
    )


SEGMENTS_SQL = """(select cast(user_id as varchar) as call_id, cast(event_id % 97 as int) - 1 as seq,
 case event_type when 'click' then 'agent' when 'view' then 'customer' else event_type end as speaker, event_type as text, true as is_final,
 cast(event_id % 50 as int) as start_ms, cast(event_id % 60 as int) as end_ms, value / 400 as asr_confidence, ts as emitted_at, event_id from events)"""
REASONS_SQL = """list_filter([case when seq < 0 then 'seq' end, case when speaker not in ('customer', 'agent', 'unknown') then 'speaker' end,
 case when start_ms < 0 or end_ms < start_ms then 'times' end, case when not (asr_confidence between 0 and 1) then 'confidence' end], lambda x: x is not null)"""

def sql_map(values: dict) -> str:
    return "map {" + ", ".join("'{}': {}".format(k.replace("'", "''"), f"{v}::double") for k, v in values.items()) + "}"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sentiment_sql(turns_sql: str, weights: dict, negations: list, intensifiers: dict, phrases: dict | None = None) -> str:
    """The fold over the words as a recursion, and the phrases added at its end."""
    said = " + ".join(f"case when contains(t, '{p}') then {w}::double else 0 end" for p, w in (phrases or {}).items()) or "0.0"
    n_said = " + ".join(f"contains(t, '{p}')::int" for p in phrases or {}) or "0"
    no = f"list_contains({sql_list(negations)}, w[i + 1])"
    return f"""(with recursive tok as (select call_id, seq, speaker, lower(text) as t, regexp_extract_all(lower(text), '[a-z'']+') as w from {turns_sql}),
 walk as (select call_id, seq, speaker, t, w, 0 as i, 0.0::double as total, 0 as hits, -1 as until, 1.0::double as mult from tok
  union all select call_id, seq, speaker, t, w, i + 1,
   case when no or more is not null or wt is null then total else total + case when i <= until then wt * mult * -0.8 else wt * mult end end,
   case when no or more is not null or wt is null then hits else hits + 1 end,
   case when no then i + 3 else until end,
   case when no then mult when more is not null then more when wt is null then mult else 1.0 end
  from (select *, {no} as no, {sql_map(weights)}[w[i + 1]] as wt, {sql_map(intensifiers)}[w[i + 1]] as more from walk where i < len(w))),
 ended as (select *, total + ({said}) as whole, hits + ({n_said}) as n from walk where i = len(w))
 select call_id, seq, speaker, case when n = 0 then 0.0 else greatest(-1.0, least(1.0, whole / n * 1.35)) end as sentiment from ended)"""


SENTIMENT_SQL = sentiment_sql(TURNS_SQL, WEIGHTS, NEGATIONS, INTENSIFIERS)


def risk_sql(turns_sql: str, hits_sql: str, mood_sql: str) -> str:
    return f"""with h as (select call_id, max(weight) as peak from ({hits_sql}) group by 1),
 m as (select call_id, avg(sentiment) as mood from (select *, row_number() over (partition by call_id order by seq desc) as rn from {mood_sql} where speaker = 'customer') where rn <= 3 group by 1),
 r as (select call_id, case when mood < -0.4 then greatest(coalesce(peak, 0), 0.45 + least(0.3, abs(mood) - 0.4)) when mood > 0.25 then coalesce(peak, 0) * 0.55 else coalesce(peak, 0) end as raw
  from (select distinct call_id from {turns_sql}) left join h using (call_id) left join m using (call_id))
 select call_id, round(least(raw, 1.0), 3) as risk, case when raw >= 0.75 then 'high' when raw >= 0.45 then 'medium' when raw >= 0.2 then 'low' else 'none' end as band from r"""


def hits_sql(turns_sql: str, patterns: list[tuple[str, float, str]]) -> str:
    rows = ", ".join("('{}', {}::double, '{}')".format(n, w, p.replace("'", "''")) for p, w, n in patterns)
    return f"select call_id, seq, label, weight from {turns_sql} join (values {rows}) p(label, weight, pattern) on regexp_matches(text, pattern) where speaker <> 'agent'"


SCORES_SQL = f"""(select call_id, intent, round(sum(w * case when speaker = 'customer' then 1.0 else 0.45 end * (1.0 - 0.5 * idx / n)), 6) as score
 from (select *, row_number() over (partition by call_id order by seq) - 1 as idx, count(*) over (partition by call_id) as n from {TURNS_SQL})
 join (values ('the_topic', 'the', 1.0::double), ('the_topic', 'of', 0.5), ('in_topic', 'in ', 1.0), ('in_topic', 'to', 0.75)) k(intent, phrase, w) on contains(lower(text), phrase) group by 1, 2)"""


def resolution_sql(turns_sql: str, follow_up: list, resolved: list, escalated_sql: str, up: list) -> str:
    has = lambda words: "(" + " or ".join("contains(lower(text), '{}')".format(w.replace("'", "''")) for w in words) + ")"
    return f"""select call_id, case when u then 'escalated' when f is not null then 'follow_up_required' when r is not null then 'resolved' else 'unresolved' end as resolution,
 coalesce(case when u then e else coalesce(f, r) end, last) as seq from (select call_id, max(seq) as last, max(seq) filter (rn <= 5 and {has(follow_up)}) as f, max(seq) filter (rn <= 5 and {has(resolved)}) as r,
 max(seq) filter ({has(up)}) as e, call_id in ({escalated_sql}) as u from (select *, row_number() over (partition by call_id order by seq desc) as rn from {turns_sql}) group by call_id)"""


SCRUBBED = r"regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[email]', 'g'), '[0-9](?:[ -]?[0-9]){6,}', '[digits]', 'g')"


def _pct(part: str, whole: str, digits: int = 2) -> str:
    return f"round(100.0 * ({part}) / ({whole}), {digits})"


def spans_sql(kind: str, pattern: str, documents: str = "documents") -> str:
    """Positions by splitting: gap lengths and match lengths summed up; a group stands at its match's end."""
    type_, confidence, _ = pii.DETECTORS[kind]
    p = re.sub(r"([+*])\+", r"\1", pattern).replace("'", "''")  # possessive repeats are there for speed only
    sure = f"cast({confidence} as double)"
    if kind in pii.SURER:
        words = ", ".join(f"'{w}'" for w in CONTEXT[type_])
        around = f'lower(substring(text, greatest(start - {NEAR}, 0) + 1, "end" + {NEAR} - greatest(start - {NEAR}, 0)))'
        sure = f"case when len(list_filter([{words}], lambda w: contains({around}, w))) > 0 then {pii.SURER[kind]} else {sure} end::double"
    value = f"regexp_extract(v[i], '{p}', 1)" if kind in pii.GROUPED else "v[i]"
    accept = {
        "account_labelled": "length(regexp_replace(value, '[^0-9]', '', 'g')) >= 5",
        "person_trigger": f"not regexp_matches(value, '(?i)^(?:{pii.NOT_NAMES})(?:\\s|$)')",
        "spoken_email": f"regexp_matches(value, '{pii.DOMAINS}')",
    }.get(kind, "true")
    return f"""with m as (select doc_id, text, regexp_extract_all(text, '{p}') as v, regexp_split_to_array(text, '{p}') as g from {documents} where regexp_matches(text, '{p}')),
 e as (select doc_id, text, v, g, unnest(range(1, len(v) + 1)) as i from m),
 s as (select text, doc_id as call_id, cast(0 as bigint) as seq, '{type_}' as type, {value} as value,
 cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(v[1:i], lambda x: length(x))) as int) as "end", '{kind}' as detector from e),
 t as (select *, cast("end" - length(value) as int) as start from s where {accept})
 select call_id, seq, type, start, "end", detector, {sure} as confidence from t"""


LUHN_SQL = """select call_id, digits from (select call_id, substring(text, start + 1, "end" - start) as digits from ({spans}) join documents on doc_id = call_id)
 where (with d as (select regexp_replace(digits, '[^0-9]', '', 'g') as x) select length(x) >= 12 and list_sum(list_transform(range(1, length(x) + 1),
 lambda i: case when (length(x) - i) % 2 = 0 then substring(x, i, 1)::int when substring(x, i, 1)::int > 4 then substring(x, i, 1)::int * 2 - 9 else substring(x, i, 1)::int * 2 end)) % 10 = 0 from d)"""


def queries() -> dict:
    q = {
        "intent_distribution": lambda s, d: marts.intent_distribution(summaries(s, d)),
        "sentiment_by_hour": lambda s, d: marts.sentiment_by_hour(summaries(s, d)),
        "violations_by_policy": lambda s, d: marts.violations_by_policy(signals(s, d), KIND, 7, "2024-01-31"),
        "violation_rate": lambda s, d: marts.violation_rate(signals(s, d), summaries(s, d), KIND, None),
        "policy_violation_rates": lambda s, d: marts.policy_violation_rates(signals(s, d), KIND),
        "latency_percentiles": lambda s, d: marts.latency_percentiles(signals(s, d), 400, "signal_type"),
        "overview": lambda s, d: marts.overview(summaries(s, d)),
        "agent_daily": lambda s, d: marts.rollup_agent_daily(summaries(s, d)).withColumn("delta_sum", F.round("delta_sum", 4) + 0.0),
        "agent_league": lambda s, d: marts.agent_league(marts.rollup_agent_daily(summaries(s, d))),
        "signals_rollup_merged": lambda s, d: marts.merge_signals(marts.rollup_signals_hourly(signals(s, d)), ["signal_type"]),
        "recent_calls": lambda s, d: marts.recent_calls(summaries(s, d), 50).select("call_id", "agent_id", "ended_at"),
        "current_summaries": lambda s, d: marts.current_summaries(signals(s, d), "signal_id").select("call_id", "signal_id"),
        "rank_signals": lambda s, d: marts.rank_signals(signals(s, d)).select("call_id", "signal_id", "rank"),
        "active_calls": lambda s, d: marts.active_calls(signals(s, d)),
        "replay_tail": lambda s, d: marts.replay_tail(signals(s, d), 400).select("signal_id", "emitted_at"),
        "call_detail": lambda s, d: marts.call_detail(summaries(s, d), signals(s, d)).select("call_id", "resolution", F.coalesce(F.size("signals"), F.lit(0)).alias("n_signals"), F.get("signals", F.lit(0))["signal_id"].alias("first_signal")),
        "retention": lambda s, d: marts.apply_retention(signals(s, d), "emitted_at", 10, "2024-01-31").select("signal_id"),
        "segment_reasons": lambda s, d: contracts.validate_segments(_segments(s, d)).select("event_id", F.array_join("reasons", ",").alias("reasons")),
        "segment_dedupe": lambda s, d: contracts.dedupe_segments(_segments(s, d), "event_id").select("call_id", "seq", "event_id"),
        "ingest_outcomes": lambda s, d: contracts.ingest_outcomes(_segments(s, d), "event_id"),
        "latest_hypothesis": lambda s, d: contracts.latest_hypothesis(_segments(s, d)).select("call_id", "seq", "event_id"),
        "sequence_gaps": lambda s, d: contracts.sequence_gaps(_segments(s, d)),
        "drop_weak": lambda s, d: contracts.drop_weak(signals(s, d)).select("signal_id"),
        "scrub": lambda s, d: contracts.scrub(documents(s, d), "text").select("call_id", F.md5("text").alias("scrubbed")),
        "index_turns": lambda s, d: conversation.index_turns(turns(s, d)).select("call_id", "seq", F.col("idx").cast("long").alias("idx")),
        "call_facts": lambda s, d: conversation.call_facts(turns(s, d)),
        "transcripts": lambda s, d: conversation.render_transcripts(turns(s, d)),
        "live_windows": lambda s, d: conversation.live_windows(turns(s, d)),
        "carry_context": lambda s, d: pii.carry_context(turns(s, d)).select("call_id", "seq", "context"),
        "sentiment": lambda s, d: _sentiment(s, d).select("call_id", "seq", F.round("sentiment", 8).alias("sentiment")),
        "sentiment_endpoints": lambda s, d: conversation.sentiment_endpoints(_sentiment(s, d)),
        "escalation_hits": lambda s, d: conversation.pattern_hits(turns(s, d), PATTERNS).select("call_id", "seq", "label", "weight"),
        "escalation_risk": lambda s, d: conversation.escalation_risk(turns(s, d), conversation.pattern_hits(turns(s, d), PATTERNS), _sentiment(s, d)),
        "compliance_hits": lambda s, d: conversation.phrase_hits(turns(s, d), PHRASES),
        "disclosure_status": lambda s, d: conversation.disclosure_status(turns(s, d), REQUIRED),
        "intent_scores": _scores,
        "intents": lambda s, d: conversation.classify_intent(turns(s, d), _scores(s, d), list(INTENTS)),
        "resolution": lambda s, d: conversation.classify_resolution(
            turns(s, d), ["that the"], ["with", "and the"], conversation.escalated_flag(conversation.pattern_hits(turns(s, d), PATTERNS), ["of_the"]), ["of the"]
        ),
        "search_turns": lambda s, d: conversation.search_turns(turns(s, d), turns(s, d).select("call_id").distinct().withColumn("query", F.lit("the of and in")), 3),
        "redact": lambda s, d: pii.redact(spread(documents(s, d))).select("call_id", "seq", F.md5("text").alias("redacted"), "n_redactions"),
        "placeholders": lambda s, d: pii.assign_placeholders(pii.detect_pii(spread(documents(s, d)))),
        "redaction_summary": lambda s, d: pii.redaction_summary(pii.pii_spans(documents(s, d), ["email", "phone", "account_labelled"])),
        "long_digit_runs": lambda s, d: pii.long_digit_runs(documents(s, d)),
        "luhn": lambda s, d: pii.luhn_filter(pii.detect_pii(documents(s, d), ["long_digits"]).select("call_id", F.explode("spans.value").alias("digits")), "digits"),
        "quality_prf": lambda s, d: quality.binary_prf(_gold(s, d), "predicted", "quality", ["lang"], 2.0),
        "quality_accuracy": lambda s, d: quality.accuracy(_gold(s, d), "predicted", "quality"),
        "confusions": lambda s, d: quality.confusions(_gold(s, d), "predicted", "quality"),
        "nearest_rank": lambda s, d: quality.nearest_rank(signals(s, d), "duration_ms", "signal_type", 0.95),
        "capacity": lambda s, d: quality.capacity(signals(s, d), 160.0, "agent_id"),
        "call_sessions": lambda s, d: streaming.close_calls(signals(s, d), "6 hours"),
        "signals_hourly": lambda s, d: streaming.signals_hourly(signals(s, d)),
        "call_activity": lambda s, d: streaming.call_activity(signals(s, d).withColumn("seq", F.expr("signal_id % 97"))),
        "slo_alerts": lambda s, d: streaming.slo_alerts(signals(s, d), 150.0),
    }
    for kind in pii.DETECTORS:
        q[f"pii_{kind}"] = lambda s, d, k=kind: pii.pii_spans(documents(s, d), [k])
    from callscope.plans import calls, evidence, insights, more, shipped

    return q | evidence.queries() | calls.queries() | insights.queries() | shipped.queries() | more.queries()


def oracle_sql() -> dict:
    from callscope.plans import calls, evidence, insights, more, shipped

    named = base_sql() | evidence.oracle_sql() | calls.oracle_sql()
    named["judge_calls"] = named["judge_calls"].replace("%EVIDENCE%", named["intent_evidence"])
    return named | insights.oracle_sql() | shipped.oracle_sql() | more.oracle_sql()


def base_sql() -> dict:
    sm, sg, tn, seg = SUMMARIES_SQL, SIGNALS_SQL, TURNS_SQL, SEGMENTS_SQL
    gold = "(select lang, quality, cast(length(text) >= 400 as int) as predicted from labels join documents using (doc_id))"
    rank = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end"
    daily = f"select ended_date as day, agent_id, count(*) as calls, cast(sum(escalated) as bigint) as escalations, cast(sum(violation_count) as bigint) as violations, count(*) filter (resolution = 'resolved') as resolved, sum(sentiment_end - sentiment_start) as delta_sum, cast(sum(turn_count) as bigint) as turns from {sm} group by 1, 2"
    counts = f"select lang, count(*) filter (predicted = 1 and quality = 1) as tp, count(*) filter (predicted = 1 and quality = 0) as fp, count(*) filter (predicted = 0 and quality = 1) as fn from {gold} group by 1"
    q = {
        "intent_distribution": f"select primary_intent, count(*) as calls, count(*) filter (escalated = 1) as escalated_calls, {_pct('count(*) filter (escalated = 1)', 'count(*)')} as escalation_rate_pct, {_pct("count(*) filter (resolution = 'resolved')", 'count(*)')} as resolved_pct, round(avg(turn_count), 1) as avg_turns, round(100.0 * count(*) / sum(count(*)) over (), 2) as share_pct from {sm} group by 1",
        "sentiment_by_hour": f"select date_trunc('hour', ended_at) as hour, count(*) as calls, round(avg(sentiment_start), 3) + 0.0 as avg_start, round(avg(sentiment_end), 3) + 0.0 as avg_end, round(avg(sentiment_end - sentiment_start), 3) + 0.0 as avg_delta, count(*) filter (sentiment_end < -0.4) as ended_unhappy from {sm} group by 1",
        "violations_by_policy": f"select policy_id, count(*) as events from {sg} where signal_type = '{KIND}' and emitted_at >= date '2024-01-24' group by 1",
        "violation_rate": f"select policy_id, calls_with_violation, severe_events, avg_confidence, total_calls, {_pct('calls_with_violation', 'total_calls')} as violation_rate_pct from (select policy_id, count(distinct call_id) as calls_with_violation, count(*) filter (severity in ('critical', 'high')) as severe_events, round(avg(confidence), 3) as avg_confidence from {sg} where signal_type = '{KIND}' group by 1), (select count(distinct call_id) as total_calls from {sm})",
        "policy_violation_rates": f"select policy_id, count(distinct call_id) as calls, count(*) as events, round(avg(confidence), 4) as avg_confidence, count(*) filter (severity in ('critical', 'high')) as severe_events from {sg} where signal_type = '{KIND}' group by 1",
        "latency_percentiles": f"select signal_type as stage, count(*) as samples, round(quantile_cont(duration_ms, 0.5), 1) as p50_ms, round(quantile_cont(duration_ms, 0.95), 1) as p95_ms, round(quantile_cont(duration_ms, 0.99), 1) as p99_ms, round(max(duration_ms), 1) as max_ms, {_pct('count(*) filter (duration_ms > 400)', 'count(*)', 3)} as pct_over_budget from {sg} group by 1",
        "overview": f"select count(*) as calls, cast(sum(escalated) as bigint) as escalations, cast(sum(violation_count) as bigint) as violations, {_pct('sum(escalated)', 'count(*)')} as escalation_pct, round(sum(violation_count) / count(*), 3) as violations_per_call, round(avg(sentiment_end - sentiment_start), 3) + 0.0 as avg_delta from {sm}",
        "agent_daily": f"select day, agent_id, calls, escalations, violations, resolved, round(delta_sum, 4) + 0.0 as delta_sum, turns from ({daily})",
        "agent_league": f"select agent_id, cast(sum(calls) as bigint) as call_count, cast(sum(escalations) as bigint) as escalation_count, {_pct('sum(escalations)', 'sum(calls)')} as escalation_rate_pct, cast(sum(violations) as bigint) as violation_count, {_pct('sum(resolved)', 'sum(calls)')} as resolved_pct, round(sum(delta_sum) / sum(calls), 3) + 0.0 as sentiment_delta, round(sum(turns) / sum(calls), 1) as turns_per_call from ({daily}) group by 1 having sum(calls) >= 3",
        "recent_calls": f"select call_id, agent_id, ended_at from {sm} order by ended_at desc, call_id limit 50",
        "current_summaries": f"select call_id, max(signal_id) as signal_id from {sg} group by 1",
        "rank_signals": f"select call_id, signal_id, cast(row_number() over (partition by call_id order by {rank}, confidence desc, signal_id) as int) as rank from {sg}",
        "active_calls": f"select call_id, max(emitted_at) as last_seen from {sg} group by 1",
        "replay_tail": f"select signal_id, emitted_at from {sg} order by emitted_at desc, signal_id desc limit 400",
        "call_detail": f"select s.call_id, resolution, coalesce(n, 0)::int as n_signals, first_signal from {sm} s left join (select call_id, count(*) as n, arg_min(signal_id, (emitted_at, signal_id)) as first_signal from {sg} group by 1) g on s.call_id = g.call_id",
        "retention": f"select signal_id from {sg} where emitted_at >= date '2024-01-21'",
        "segment_reasons": f"select event_id, array_to_string({REASONS_SQL}, ',') as reasons from {seg}",
        "segment_dedupe": f"select call_id, seq, min(event_id) as event_id from {seg} group by 1, 2",
        "ingest_outcomes": f"select case when len(r) > 0 then 'rejected' when rn > 1 then 'duplicate' else 'accepted' end as outcome, case when len(r) > 0 then r[1] else '' end as reason, count(*) as segments from (select r, row_number() over (partition by call_id, seq, len(r) > 0 order by event_id) as rn from (select *, {REASONS_SQL} as r from {seg})) group by 1, 2",
        "latest_hypothesis": f"select call_id, seq, arg_max(event_id, emitted_at) as event_id from {seg} group by 1, 2",
        "sequence_gaps": f"select call_id, after, seq - after - 1 as missing from (select call_id, seq, lag(seq) over (partition by call_id order by seq) as after from (select distinct call_id, seq from {seg})) where seq > after + 1",
        "drop_weak": f"select signal_id from {sg} where confidence >= 0.35",
        "scrub": f"select doc_id as call_id, md5({SCRUBBED}) as scrubbed from documents",
        "index_turns": f"select call_id, seq, row_number() over (partition by call_id order by seq) - 1 as idx from {tn}",
        "call_facts": f"select call_id, count(*) as turn_count, max(end_ms) - min(start_ms) as duration_ms, count(distinct speaker) as speakers from {tn} group by 1",
        "transcripts": f"select call_id, string_agg('[' || idx || '] ' || speaker || ': ' || text, chr(10) order by idx) as transcript from (select *, row_number() over (partition by call_id order by seq) - 1 as idx from {tn}) group by 1",
        "live_windows": f"select call_id, idx::int as idx, first_seq, turns::int as turns from (select call_id, row_number() over (partition by call_id order by seq) - 1 as idx, min(seq) over w as first_seq, count(*) over w as turns from {tn} window w as (partition by call_id order by seq rows between 5 preceding and current row)) where (idx + 1) % 2 = 0",
        "carry_context": f"select call_id, seq, right(coalesce(string_agg(text, ' ') over (partition by call_id order by seq rows between unbounded preceding and 1 preceding), ''), 240) as context from {tn}",
        "sentiment": f"select call_id, seq, round(sentiment, 8) as sentiment from {SENTIMENT_SQL}",
        "sentiment_endpoints": f"select call_id, round(avg(sentiment) filter (k <= t), 3) as start, round(avg(sentiment) filter (k > n - t), 3) as \"end\" from (select *, greatest(1, n // 3) as t from (select *, row_number() over (partition by call_id order by seq) as k, count(*) over (partition by call_id) as n from {SENTIMENT_SQL} where speaker = 'customer')) group by 1",
        "escalation_hits": hits_sql(tn, PATTERNS),
        "escalation_risk": risk_sql(tn, hits_sql(tn, PATTERNS), SENTIMENT_SQL),
        "compliance_hits": f"select call_id, policy_id, phrase, min(seq) as seq from {tn} join (values ('P1', 'that'), ('P2', 'with'), ('P3', 'the th')) p(policy_id, phrase) on contains(lower(text), phrase) where speaker = 'agent' group by 1, 2, 3",
        "disclosure_status": f"select call_id, policy_id, bool_or(contains(lower(text), phrase)) as given, min(case when contains(lower(text), phrase) then seq end) as seq, coalesce(min(case when contains(lower(text), phrase) then seq end), min(seq)) as anchor from (select *, row_number() over (partition by call_id order by seq) as k from {tn} where speaker = 'agent') join (values ('P1', 'that', 3), ('P2', 'with', null), ('P3', 'of', 2)) p(policy_id, phrase, n) on n is null or k <= n group by 1, 2",
        "intent_scores": f"select * from {SCORES_SQL}",
        "intents": f"""with s as (select *, row_number() over (partition by call_id order by score desc, case intent when 'the_topic' then 1 else 2 end) as rn, max(score) over (partition by call_id) as top from {SCORES_SQL}),
 p as (select call_id, max(case when rn = 1 then intent end) as p, coalesce(string_agg(case when rn > 1 then intent end, ',' order by rn), '') as s from s where rn = 1 or (rn <= 4 and score >= 0.45 * top) group by 1)
 select t.call_id, coalesce(p, 'general_inquiry') as primary_intent, coalesce(s, '') as secondary from (select distinct call_id from {tn}) t left join p on t.call_id = p.call_id""",
        "resolution": resolution_sql(tn, ["that the"], ["with", "and the"], f"select call_id from ({hits_sql(tn, PATTERNS[1:])})", ["of the"]),
        "search_turns": f"select call_id, 'the of and in' as query, seq, overlap::int as overlap, rank::int as rank from (select *, row_number() over (partition by call_id order by overlap desc, seq) as rank from (select call_id, seq, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z'']+')), ['the', 'of', 'and', 'in'])) as overlap from {tn}) where overlap > 0) where rank <= 3",
        "long_digit_runs": "select doc_id as call_id, cast(0 as bigint) as seq, len(regexp_extract_all(text, '[0-9]{7,}'))::int as runs from documents where regexp_matches(text, '[0-9]{7,}')",
        "quality_prf": f"select lang, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when 4 * p + r = 0 then 0 else 5 * p * r / (4 * p + r) end, 6) as f from (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as p, case when tp + fn = 0 then 0 else tp / (tp + fn) end as r from ({counts}))",
        "quality_accuracy": f"select count(*) as n, count(*) filter (predicted = quality) as correct, round(avg(cast(predicted = quality as int)), 6) as accuracy from {gold}",
        "confusions": f"select gold, predicted, n, rank::int as rank from (select *, row_number() over (partition by gold order by n desc, predicted) as rank from (select quality as gold, predicted, count(*) as n from {gold} where quality <> predicted group by 1, 2)) where rank <= 6",
        "nearest_rank": f"select signal_type, duration_ms as value from (select signal_type, duration_ms, row_number() over (partition by signal_type order by duration_ms) as k, count(*) over (partition by signal_type) as n from {sg}) where k = least(greatest(round_even(0.95 * n + 0.5, 0), 1), n)",
        "capacity": f"""with l as (select agent_id as level, round(quantile_cont(duration_ms, 0.5), 3) as p50_ms, round(quantile_cont(duration_ms, 0.95), 3) as p95_ms, round(quantile_cont(duration_ms, 0.99), 3) as p99_ms from {sg} group by 1),
 b as (select min(level) as breach from l where p95_ms > 160), x as (select *, (breach is null or level < breach) as sustained from l, b)
 select level, p50_ms, p95_ms, p99_ms, p95_ms <= 160 as within, sustained, (select max(level) filter (sustained) from x) as most from x""",
        "call_sessions": f"select call_id, min(emitted_at) as started_at, max(emitted_at) + interval 6 hours as ended_at, count(*) as segments from (select *, sum(case when gap is null or gap >= interval 6 hours then 1 else 0 end) over (partition by call_id order by emitted_at) as g from (select call_id, emitted_at, emitted_at - lag(emitted_at) over (partition by call_id order by emitted_at) as gap from {sg})) group by call_id, g",
        "signals_hourly": f"select date_trunc('hour', emitted_at) as hour, signal_type, count(*) as events from {sg} group by 1, 2",
        "call_activity": f"select call_id, min(emitted_at) as first_seen, max(emitted_at) as last_seen, count(*) as segments, count(*) - count(distinct signal_id % 97) as duplicates, max(signal_id % 97) as last_seq from {sg} group by 1",
        "slo_alerts": f"select * from (select date_trunc('day', emitted_at) as window_start, signal_type, round(quantile_cont(duration_ms, 0.95), 6) as p95_ms, count(*) as samples from {sg} group by 1, 2) where p95_ms > 150",
    }
    for kind in ("email", "ssn", "phone", "dob_numeric", "dob_wordy", "account_labelled", "address", "long_digits", "person_trigger"):
        q[f"pii_{kind}"] = spans_sql(kind, pii.DETECTORS[kind][2])
    q["luhn"] = LUHN_SQL.replace("{spans}", q["pii_long_digits"])
    return q
