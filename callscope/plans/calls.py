"""Registered queries over summaries, gates, intent evidence and operations panels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope import plans, streaming
from callscope.operators import conversation, holds, summaries
from callscope.testdata import SIGNALS_SQL, TURNS_SQL, turns
from callscope.testdata import signals as events

INTENTS = ["the_topic", "in_topic", "other", "general_inquiry"]
POLICIES = ["P1", "P2", "P3"]
#: The windows of the demo disclosures, in agent turns.
WINDOWS = {policy: n for policy, _, n in plans.REQUIRED}


def _raw(s, d):
    """One raw summary a call, with the faults that the coercion mends or rejects."""
    calls = turns(s, d).groupBy("call_id").agg(F.min_by("text", "seq").alias("first"))
    return calls.selectExpr(
        "call_id", "if(call_id % 13 = 0, '  ', first) as summary",
        "element_at(array('the_topic', ' in_topic ', '', 'unheard_of', 'other'), cast(call_id % 5 as int) + 1) as primary_intent",
        "array('other', 'in_topic', 'unheard_of', 'the_topic') as secondary_intents",
        "element_at(array('resolved', 'unresolved', 'escalated', 'follow_up_required', 'closed', 'resolved', 'resolved'), cast(call_id % 7 as int) + 1) as resolution",
        "if(call_id % 11 = 0, 'bad', cast((call_id % 31 - 15) / 10 as string)) as customer_sentiment_start",
        "cast((call_id % 7 - 3) / 4 as string) as customer_sentiment_end",
        "array('P3', 'P9', ' P1', 'P3') as compliance_violations", "if(call_id % 3 = 0, null, array('P2')) as disclosures_given",
        """array(named_struct('description', first, 'owner', 'System ', 'due', cast(null as string), 'evidence_turns', array(cast(call_id % 9 as string), 'x', '0')),
         named_struct('description', ' call back ', 'owner', 'boss', 'due', 'today', 'evidence_turns', array(cast(call_id % 9 as string))),
         named_struct('description', '', 'owner', 'agent', 'due', 'today', 'evidence_turns', array('0'))) as action_items""",
    )


def _coerced(s, d):
    return summaries.coerce_summaries(_raw(s, d), INTENTS, POLICIES, turns(s, d))


def _flat(df):
    join = lambda c: F.array_join(c, ",").alias(c)
    items = F.array_join(F.transform("action_items", lambda i: F.concat(i["owner"], F.lit(":"), F.array_join(F.transform(i["evidence"], lambda e: e["seq"].cast("string")), "+"))), ",")
    return df.select(
        "call_id", F.coalesce("reason", F.lit("")).alias("reason"), F.md5(F.col("summary")).alias("summary"), "primary_intent", join("secondary_intents"), "resolution",
        "customer_sentiment_start", "customer_sentiment_end", join("compliance_violations"), join("disclosures_given"), items.alias("items"),
    )


def _envelopes(s, d):
    one = F.array(F.col("signal_id"))
    return events(s, d).select(
        "signal_id", F.element_at(F.array(F.lit("live"), F.lit("post_call"), F.lit("other")), (F.col("signal_id") % 3 + 1).cast("int")).alias("kind"), "call_id", "emitted_at",
        F.when(F.col("signal_id") % 4 > 0, one).otherwise(F.slice(one, 1, 0)).alias("signals"), F.when(F.col("signal_id") % 5 > 0, F.struct("call_id")).alias("summary"),
    )


def _read_out(s, d):
    """Turns of which every third ends in a number that is being read out."""
    number = F.concat("text", F.lit(" card number "), (F.col("call_id") % 9000 + 1000).cast("string"))
    return turns(s, d).withColumn("text", F.when(F.col("seq") % 3 == 0, number).otherwise(F.col("text")))


def _stages(s, d):
    return events(s, d).withColumnRenamed("signal_type", "stage")


def queries() -> dict:
    return {
        "disclosure_gate": lambda s, d: conversation.disclosure_gate(conversation.disclosure_status(turns(s, d), plans.REQUIRED), turns(s, d), WINDOWS).select("call_id", "policy_id", "given", "closed"),
        "intent_evidence": lambda s, d: conversation.intent_evidence(turns(s, d), plans.INTENTS),
        "coerce_summaries": lambda s, d: _flat(_coerced(s, d)),
        "summary_reasons": lambda s, d: summaries.validate_summaries(_raw(s, d).withColumn("action_items", F.expr("transform(action_items, i -> named_struct('description', i.description, 'owner', i.owner, 'evidence', i.evidence_turns))")).withColumn("customer_sentiment_start", F.expr("try_cast(customer_sentiment_start as double)"))).select("call_id", F.array_join("reasons", ",").alias("reasons")),
        "envelope_reasons": lambda s, d: summaries.validate_envelopes(_envelopes(s, d)).select("signal_id", F.array_join("reasons", ",").alias("reasons")),
        "hold_calls": lambda s, d: holds.hold_calls(_read_out(s, d)).select("call_id", "seq", "part", F.md5("text").alias("text"), "held_digits"),
        "redact_calls": lambda s, d: holds.redact_calls(_read_out(s, d)).select("call_id", "seq", "part", F.md5("text").alias("text"), "n_redactions"),
        "preview_partials": lambda s, d: holds.preview_partials(_read_out(s, d).withColumn("is_final", F.col("seq") % 2 > 0)).select("call_id", "seq", F.md5("text").alias("text"), "held_digits"),
        "stage_throughput": lambda s, d: streaming.stage_throughput(_stages(s, d), "1 hour"),
        "ops_ratios": lambda s, d: streaming.ops_ratios(events(s, d), "signal_type", "1 day"),
    }


def oracle_sql() -> dict:
    own = plans.base_sql()
    windows = ", ".join(f"('{p}', {'null' if n is None else n})" for p, n in WINDOWS.items())
    phrases = ", ".join(f"('{i}', '{p}', {w}, {k})" for i, x in plans.INTENTS.items() for k, (p, w) in enumerate(x.items()))
    raw = f"""(select call_id, case when call_id % 13 = 0 then '  ' else first end as summary, first,
 (['the_topic', ' in_topic ', '', 'unheard_of', 'other'])[call_id % 5 + 1] as primary_intent,
 (['resolved', 'unresolved', 'escalated', 'follow_up_required', 'closed', 'resolved', 'resolved'])[call_id % 7 + 1] as resolution,
 case when call_id % 11 > 0 then (call_id % 31 - 15) / 10 end as mood from (select call_id, arg_min(text, seq) as first from {TURNS_SQL} group by 1))"""
    indexed = f"(select *, row_number() over (partition by call_id order by seq) - 1 as idx from {TURNS_SQL})"
    found = f"(select call_id, any_value(seq) filter (idx = call_id % 9) as a, any_value(seq) filter (idx = 0) as z from {indexed} group by 1)"
    intent = "coalesce(nullif(trim(primary_intent), ''), 'general_inquiry')"
    return {
        "disclosure_gate": f"""select call_id, policy_id, given, coalesce(agent_turns > n, false) as closed from ({own['disclosure_status']})
 join (select call_id, count(*) filter (speaker = 'agent') as agent_turns from {TURNS_SQL} group by 1) using (call_id) join (values {windows}) w(policy_id, n) using (policy_id)""",
        "intent_evidence": f"""select call_id, intent, seq, phrase, start, start + length(phrase) as "end" from (select *, instr(lower(text), phrase)::int - 1 as start,
 row_number() over (partition by call_id, intent order by w * case when speaker = 'customer' then 1 else 0.45 end desc, seq, k) as rn
 from {TURNS_SQL}, (values {phrases}) p(intent, phrase, w, k) where contains(lower(text), phrase)) where rn = 1""",
        "coerce_summaries": f"""select call_id, case when i not in ('the_topic', 'in_topic', 'other', 'general_inquiry') then 'primary_intent' when resolution = 'closed' then 'resolution' else '' end as reason,
 md5(coalesce(nullif(substring(trim(summary), 1, 2000), ''), 'No summary produced.')) as summary, i as primary_intent,
 array_to_string(list_filter(['other', 'in_topic', 'the_topic'], lambda v: v <> i), ',') as secondary_intents, resolution,
 coalesce(greatest(-1.0, least(1.0, mood)), 0.0)::double as customer_sentiment_start, ((call_id % 7 - 3) / 4)::double as customer_sentiment_end, 'P1,P3' as compliance_violations,
 case when call_id % 3 = 0 then '' else 'P2' end as disclosures_given,
 concat_ws(',', case when length(trim(first)) > 0 then 'system:' || concat_ws('+', a, z) end, case when a is not null then 'agent:' || a end) as items
 from (select *, {intent} as i from {raw}) left join {found} using (call_id)""",
        "summary_reasons": f"""select call_id, concat_ws(',', case when not length(summary) between 1 and 2000 then 'summary' end, case when resolution = 'closed' then 'resolution' end,
 case when primary_intent = '' then 'primary_intent' end, 'items', case when mood is null or not mood between -1 and 1 then 'customer_sentiment_start' end) as reasons from {raw}""",
        "envelope_reasons": f"""select signal_id, concat_ws(',', case when signal_id % 3 = 2 then 'kind' end, case when signal_id % 12 = 0 then 'signals' end,
 case when signal_id % 3 = 1 and signal_id % 5 = 0 then 'payload' end) as reasons from {SIGNALS_SQL}""",
        "stage_throughput": f"""select date_trunc('hour', emitted_at) as window_start, signal_type as stage, count(*) as samples, round(quantile_cont(duration_ms, 0.5), 6) as p50_ms,
 round(quantile_cont(duration_ms, 0.95), 6) as p95_ms from {SIGNALS_SQL} group by 1, 2""",
        "ops_ratios": f"""select date_trunc('day', emitted_at) as window_start, signal_type as label, count(*) as events,
 round(count(*) / sum(count(*)) over (partition by date_trunc('day', emitted_at)), 6) as share from {SIGNALS_SQL} group by 1, 2""",
    }
