"""Registered queries over selected quantiles, versions, breakdowns, reports and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope import plans, streaming
from callscope.operators import contracts, conversation, marts, order, pii, scoring
from callscope.operators import signals as judged
from callscope.testdata import SIGNALS_SQL, SUMMARIES_SQL, TURNS_SQL, documents, signals, summaries, table, turns

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _versions(s, d):
    """Summaries, and a later version of every fifth: another agent, escalated the other way."""
    first = summaries(s, d).withColumn("version", F.lit(1))
    again = first.where("call_id % 5 = 0").withColumns({"version": F.lit(2), "agent_id": F.expr("(agent_id + 1) % 50"), "escalated": F.expr("cast(1 - escalated as int)")})
    return first.unionByName(again)


CURRENT_SQL = f"""(select * replace (case when call_id % 5 = 0 then (agent_id + 1) % 50 else agent_id end as agent_id,
 case when call_id % 5 = 0 then 1 - escalated else escalated end as escalated) from {SUMMARIES_SQL})"""


def _nested(s, d):
    """Events as JSON with keys that the contract doesn't name, at three depths."""
    return table(s, d, "events").selectExpr("event_id", """to_json(named_struct('id', event_id, 'extra', if(event_id % 3 = 0, 1, null),
     'inner', named_struct('k', 1, 'odd', if(event_id % 4 = 0, named_struct('deep', 1), null)),
     'redactions', array(named_struct('type', 'CARD', 'note', cast(null as string)), named_struct('type', 'SSN', 'note', if(event_id % 5 = 0, 'x', null))))) as body""")


def _split_ops(s, d):
    names = F.array(*map(F.lit, ["segment", "final", "redaction", "rejected", "claim", "tool"]))
    label = lambda n, k: F.concat(F.lit(n), (F.col("signal_id") % k).cast("string"))
    return signals(s, d).select(
        F.element_at(names, (F.col("signal_id") % 6).cast("int") + 1).alias("event"), (F.col("signal_id") % 9).alias("n"), "emitted_at", label("r", 4).alias("reason"), label("t", 5).alias("type"),
        label("d", 7).alias("detector"), F.when(F.col("signal_id") % 11 > 0, label("o", 8)).alias("outcome"),
    )


def _formed(s, d):
    from callscope.plans import evidence

    labels = evidence._labels(s, d).withColumns({"surface_form": F.concat(F.lit("s"), (F.col("start") % 3).cast("string")), "category": F.when(F.col("call_id") % 4 > 0, F.concat(F.lit("c"), (F.col("call_id") % 4).cast("string")))})
    return scoring.span_coverage(labels, evidence._narrow(s, d), evidence.documents(s, d))


def _report(s, d):
    from callscope.plans import evidence

    return scoring.redaction_report(_formed(s, d), pii.pii_spans(evidence.documents(s, d), [*evidence.KINDS, "long_digits"]), evidence._labels(s, d))


def _actions(s, d):
    """One summary a call with an action item a turn; those of every third turn cite nothing."""
    items = F.collect_list(F.struct(F.col("text").alias("description"), F.when(F.col("seq") % 3 > 0, F.array("seq")).alias("evidence")))
    return turns(s, d).groupBy("call_id").agg(items.alias("action_items")).withColumn("half", F.col("call_id") % 2)


def _missing(s, d):
    status = conversation.disclosure_status(turns(s, d), plans.REQUIRED)
    from callscope.plans import calls, evidence

    titles = s.createDataFrame([(p, "missing", level) for p, level in evidence.SEVERITIES], "policy_id string, title string, severity string")
    return judged.gate_missing(conversation.missing_disclosures(status, titles), conversation.disclosure_gate(status, turns(s, d), calls.WINDOWS))


def _signals(s, d):
    from callscope.plans import evidence

    return evidence._signals(s, d)


def _parts(s, d):
    from callscope.plans import evidence

    t = turns(s, d)
    return judged.summary_evidence(conversation.phrase_hits(t, plans.PHRASES), conversation.disclosure_status(t, plans.REQUIRED), conversation.action_items(t, [(evidence.PROMISE, "agent")], "^(?:zz|a)", 8))


def queries() -> dict:
    flat = lambda df: df.withColumn("evidence", F.array_join("evidence", ",")).withColumn("policy_id", F.coalesce("policy_id", F.lit("")))
    quote = lambda q: F.concat(q["speaker"], F.lit(":"), q["quote"])
    return {
        "selected_quantiles": lambda s, d: order.selected_quantiles(signals(s, d), ["signal_type"], "duration_ms", QUANTILES).select("signal_type", *[F.round(c, 6).alias(c) for c in QUANTILES]),
        "selected_by_agent": lambda s, d: order.selected_quantiles(signals(s, d), ["agent_id", "signal_type"], "confidence", {"median": 0.5}).select("agent_id", "signal_type", F.round("median", 6).alias("median")),
        "agent_daily_versions": lambda s, d: marts.rollup_agent_daily(_versions(s, d), "version").select("day", "agent_id", "calls", "escalations", "violations", "resolved", "turns"),
        "call_sketches": lambda s, d: marts.merge_call_sketches(marts.rollup_call_sketches(_versions(s, d), "version"), ["agent_id"]),
        "unknown_paths": lambda s, d: contracts.unknown_paths(_nested(s, d), "body", ["id", "inner.k", "redactions[].type"], ("event_id",)),
        "ops_breakdown": lambda s, d: streaming.ops_breakdown(_split_ops(s, d), "1 day"),
        "redaction_report": _report,
        "grounded_actions": lambda s, d: scoring.grounded_actions(_actions(s, d), ["half"]),
        "gate_missing": lambda s, d: _missing(s, d).select("call_id", "policy_id", "seq", "score"),
        "signal_windows": lambda s, d: flat(judged.with_window_bounds(_signals(s, d), turns(s, d))).select("call_id", "signal_type", "label", "policy_id", "window_start_ms", "window_end_ms"),
        "signal_quotes": lambda s, d: flat(judged.with_evidence(_signals(s, d), turns(s, d))).select("call_id", "signal_type", "label", "policy_id", F.md5(F.array_join(F.transform("quotes", quote), "|")).alias("quotes")),
        "summary_evidence": _parts,
        "redact_email": lambda s, d: pii.redact(plans.spread(documents(s, d)), ["email"]).select("call_id", F.md5("text").alias("text"), "n_redactions"),
    }


def oracle_sql() -> dict:
    from callscope.plans import calls, evidence, insights

    own, ev, sg = plans.base_sql(), evidence.oracle_sql(), SIGNALS_SQL
    day = "date_trunc('day', emitted_at)"
    split = []
    for name, (part, by, whole) in streaming.BREAKDOWNS.items():
        label = {"reason": "'r' || (signal_id % 4)", "type": "'t' || (signal_id % 5)", "detector": "'d' || (signal_id % 7)", "outcome": "case when signal_id % 11 > 0 then 'o' || (signal_id % 8) else 'none' end"}[by]
        split.append(f"""select window_start, '{name}' as breakdown, label, n, round(n / greatest(w, 1), 6) as share from (select {day} as window_start, {label} as label, sum(signal_id % 9)::bigint as n from {sg}
 where event = '{part}' group by 1, 2) join (select {day} as window_start, coalesce(sum(signal_id % 9) filter (event = '{whole}'), 0) as w from {sg} group by 1) using (window_start)""")
    events = f"(select *, (['segment', 'final', 'redaction', 'rejected', 'claim', 'tool'])[signal_id % 6 + 1] as event from {sg})"
    spans = " union all ".join(f"select call_id, start, \"end\", type, detector from ({own[f'pii_{k}']})" for k in evidence.KINDS)
    card = lambda view, name: f"select '{view}' as view, {name} as name, count(*) filter (covered) as tp, count(*) filter (not covered) as fn, count(*) filter (type_correct) as ok from c group by 2"
    bounds = f"(select call_id, min(start_ms) as window_start_ms, max(end_ms) as window_end_ms from (select *, row_number() over (partition by call_id order by seq desc) as k from {TURNS_SQL}) where k <= 6 group by 1)"
    windows = ", ".join(f"('{p}', {'null' if n is None else n})" for p, n in calls.WINDOWS.items())
    placed = insights.base_sql()["placeholders_email"]
    return {
        "redact_email": f"""with q as (select p.*, text, lag("end", 1, 0) over (partition by call_id order by start) as prev from ({placed}) p join documents on doc_id = call_id),
 r as (select call_id, string_agg(substring(text, prev + 1, start - prev) || placeholder, '' order by start) as head, max("end") as reach, count(*) as n from q group by 1)
 select doc_id as call_id, md5(coalesce(head || substring(text, reach + 1), text)) as text, coalesce(n, 0)::int as n_redactions from documents left join r on call_id = doc_id""",
        "selected_quantiles": f"select signal_type, {', '.join(f'round(quantile_cont(duration_ms, {q}), 6) as {n}' for n, q in QUANTILES.items())} from {sg} group by 1",
        "selected_by_agent": f"select agent_id, signal_type, round(quantile_cont(confidence, 0.5), 6) as median from {sg} group by 1, 2",
        "agent_daily_versions": f"""select ended_date as day, agent_id, count(*) as calls, sum(escalated)::bigint as escalations, sum(violation_count)::bigint as violations, count(*) filter (resolution = 'resolved') as resolved,
 sum(turn_count)::bigint as turns from {CURRENT_SQL} group by 1, 2""",
        "unknown_paths": "select event_id, unnest(list_filter([case when event_id % 3 = 0 then 'extra' end, case when event_id % 4 = 0 then 'inner.odd' end, case when event_id % 5 = 0 then 'redactions[].note' end], lambda x: x is not null)) as path from events",
        "ops_breakdown": " union all ".join(split).replace(f"from {sg}", f"from {events}"),
        "redaction_report": f"""with c as (select v.*, s.type, s.detector from ({ev['span_coverage']}) v join ({spans}) s using (call_id, start, "end")),
 t as ({card('type', 'type')} union all {card('surface_form', "'s' || (start % 3)")} union all {card('category', "case when call_id % 4 > 0 then 'c' || (call_id % 4) else 'unknown' end")}
  union all select 'detector', detector, count(*), 0, count(*) filter (type_correct) from c where covered group by 2),
 f as (select 'type' as view, type as name, false_positives as fp from ({ev['false_positives']}))
 select view, name, coalesce(tp, 0) as tp, coalesce(fn, 0) as fn, coalesce(fp, 0) as fp, round(tp / nullif(tp + fn, 0), 6) as recall, round(ok / nullif(tp, 0), 6) as type_accuracy from t full join f using (view, name)""",
        "grounded_actions": f"select call_id % 2 as half, count(*) as actions, count(*) filter (seq % 3 > 0) as grounded, round(avg((seq % 3 > 0)::int), 6) as grounded_share from {TURNS_SQL} group by 1",
        "gate_missing": f"""select call_id, policy_id, anchor as seq, case policy_id when 'P1' then 1.0 when 'P2' then 0.55 else 0.5 end::double as score from ({own['disclosure_status']})
 join (select call_id, count(*) filter (speaker = 'agent') as agent_turns from {TURNS_SQL} group by 1) using (call_id) join (values {windows}) w(policy_id, n) using (policy_id) where not given and coalesce(agent_turns > n, false)""",
        "signal_windows": f"select call_id, signal_type, label, coalesce(policy_id, '') as policy_id, window_start_ms, window_end_ms from ({ev['build_signals']}) join {bounds} using (call_id)",
        "signal_quotes": f"""select x.call_id, signal_type, label, policy_id, md5(string_agg(speaker || ':' || left(text, 500), '|' order by i)) as quotes from (select call_id, signal_type, label, coalesce(policy_id, '') as policy_id,
 unnest(string_split(evidence, ',')) as e, unnest(generate_series(1, len(string_split(evidence, ',')))) as i from ({ev['build_signals']})) x join {TURNS_SQL} t on t.call_id = x.call_id and t.seq = e::bigint group by all""",
        "summary_evidence": f"""select call_id, 'violation' as part, policy_id as name, coalesce(said, lost) as seq from (select call_id, policy_id, min(seq) as said from ({own['compliance_hits']}) group by 1, 2)
  full join (select call_id, policy_id, anchor as lost from ({own['disclosure_status']}) where not given) using (call_id, policy_id)
 union all select call_id, 'disclosure', policy_id, seq from ({own['disclosure_status']}) where given
 union all select call_id, 'action', left(description, 200), seq from ({ev['action_items']})""",
    }
