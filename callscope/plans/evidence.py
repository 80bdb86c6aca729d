"""Registered queries over digits, signals, evidence and redaction measures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope import plans
from callscope.operators import contracts, conversation, pii, scoring, signals
from callscope.sources import load_policies, route_insights
from callscope.testdata import SIGNALS_SQL, TURNS_SQL, documents, table, turns
from callscope.testdata import signals as events

#: A small catalog in words that the invented prose has: policy, place, text.
POLICIES = [("P0", 0, "that with was"), ("P1", 1, "no was the"), ("P2", 2, "with no one"), ("P3", 3, "was he there")]
KINDS = ["email", "phone"]
#: Severities of the demo disclosures; the last is none that the rules know.
SEVERITIES = [("P1", "critical"), ("P2", None), ("P3", "odd")]


def _policies(s):
    return s.createDataFrame(POLICIES, "policy_id string, place int, text string")


def _repeats(s, d):
    """Events as findings of the four kinds, in place order."""
    kind = F.expr("case signal_type when 'click' then 'compliance_violation' when 'view' then 'intent' when 'purchase' then 'sentiment_shift' else 'escalation_risk' end")
    return events(s, d).select("call_id", F.col("signal_id").alias("idx"), kind.alias("signal_type"), "policy_id", F.concat(F.lit("L"), F.expr("signal_id div 3 % 3")).alias("label"), "severity", "confidence", F.expr("signal_id div 50").alias("anchor"))


def _labels(s, d):
    """What the patterns find, as labels that are a little longer than the spans of a narrower scan."""
    return pii.pii_spans(documents(s, d), KINDS).select("call_id", "seq", "type", "start", "end")


def _narrow(s, d):
    """Every third span one character short of its label's start, every fifth of another type."""
    rows = pii.pii_spans(documents(s, d), KINDS)
    return rows.select("call_id", "seq", F.when(F.col("call_id") % 5 == 0, "ACCOUNT").otherwise(F.col("type")).alias("type"), F.when(F.col("call_id") % 3 == 0, F.col("start") + 2).otherwise(F.col("start")).alias("start"), "end", "detector")


def _coverage(s, d):
    return scoring.span_coverage(_labels(s, d), _narrow(s, d), documents(s, d))


def _values(s, d):
    none = F.array().cast("array<string>")
    each = [F.when(pii.HOLDS[k](F.col("text")), F.regexp_extract_all("text", F.lit(pii.PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS]
    found = F.explode_outer(F.concat(*each))  # a plain explode works out its array again in a filter
    return plans.spread(documents(s, d)).select("call_id", found.alias("value")).where("value is not null")


def _leaks(s, d):
    return scoring.find_leaks(_values(s, d), contracts.scrub(plans.spread(documents(s, d)), "text"))


def _quotes(s, d):
    """Pieces of turns as quotes; those of every third call are altered."""
    piece = F.concat(F.lit("..."), F.substring("text", 5, 30), F.lit("..."))
    return turns(s, d).select((F.col("call_id") * 1000 + F.col("seq")).alias("id"), "call_id", F.when(F.col("call_id") % 3 == 0, F.concat(piece, F.lit(" zzz"))).otherwise(piece).alias("quote"))


def _signals(s, d):
    t = turns(s, d)
    hits = conversation.pattern_hits(t, plans.PATTERNS)
    risk = conversation.escalation_risk(t, hits, plans._sentiment(s, d))
    said = conversation.phrase_hits(t, plans.PHRASES).select("call_id", "seq", "policy_id", F.col("phrase").alias("label"), F.lit(0.8).alias("score"))
    titles = s.createDataFrame([(p, "missing", level) for p, level in SEVERITIES], "policy_id string, title string, severity string")
    lost = conversation.missing_disclosures(conversation.disclosure_status(t, plans.REQUIRED), titles)
    return signals.build_signals(said, lost, risk, hits)


def _judged(s, d):
    """All kinds of signals of a call; policies of every third call were flagged before."""
    t = turns(s, d)
    hits = conversation.pattern_hits(t, plans.PATTERNS)
    risk = conversation.escalation_risk(t, hits, plans._sentiment(s, d))
    said = conversation.phrase_hits(t, plans.PHRASES).select("call_id", "seq", "policy_id", F.col("phrase").alias("label"), F.lit(0.8).alias("score"))
    titles = s.createDataFrame([(p, "missing", level) for p, level in SEVERITIES], "policy_id string, title string, severity string")
    lost = conversation.missing_disclosures(conversation.disclosure_status(t, plans.REQUIRED), titles)
    primary = _intents(s, d).select("call_id", F.col("primary_intent").alias("intent"))
    cited = conversation.intent_evidence(t, plans.INTENTS).select("call_id", "intent", "seq").join(primary, ["call_id", "intent"])
    flagged = t.where("call_id % 3 = 0").select("call_id", F.lit("P3").alias("policy_id"))
    return signals.judge_calls(said, lost, risk, hits, signals.sentiment_shift(plans._sentiment(s, d)), cited, flagged)


def _summaries(s, d):
    t = turns(s, d)
    hits = conversation.pattern_hits(t, plans.PATTERNS)
    named = conversation.phrase_hits(t, plans.PHRASES[2:])
    return signals.summarize_calls(
        conversation.call_facts(t), conversation.classify_intent(t, plans._scores(s, d), list(plans.INTENTS)), conversation.classify_resolution(t, ["that the"], ["with", "and the"], conversation.escalated_flag(hits, ["of_the"]), ["of the"]),
        conversation.sentiment_endpoints(plans._sentiment(s, d)), hits, named, conversation.disclosure_status(t, plans.REQUIRED), ["of_the"],
        conversation.action_items(t, [(PROMISE, "agent")], "^(?:zz|a)", 8),
    ).withColumn("action_items", F.array_join(F.transform("action_items", lambda i: F.concat(i["seq"].cast("string"), F.lit(":"), i["description"])), ","))


def _claims(s, d):
    kind = F.when(F.col("signal_type") == "click", signals.VIOLATION).otherwise(F.col("signal_type"))
    rows = events(s, d).select("signal_id", "call_id", F.expr("signal_id % 6").alias("seq"), kind.alias("signal_type"), "policy_id")
    return signals.ground_claims(rows, turns(s, d), _policies(s)).select("signal_id", F.coalesce("reason", F.lit("")).alias("reason"), F.md5(F.coalesce("quote", F.lit(""))).alias("quote"))


PROMISE = r"(?i)\bthe ([a-z]+ [a-z]+)"


def _intents(s, d):
    return conversation.classify_intent(turns(s, d), plans._scores(s, d), list(plans.INTENTS))


def _scoped(s):
    return load_policies(s, [{"id": "P1", "applies_when": "intent in [the_topic]"}, {"id": "P2", "applies_when": "intent in ['in_topic', other]"}, {"id": "P3"}])[0]


def _named(s, d):
    """Segments whose own call id is empty, foreign or that of the stream."""
    own = F.expr("case when signal_id % 5 = 0 then '' when signal_id % 7 = 0 then 'x' else cast(call_id as string) end")
    return events(s, d).select("signal_id", F.col("call_id").cast("string").alias("stream"), own.alias("call_id"))


def _late(s, d):
    return turns(s, d).select("call_id", "seq", (F.col("start_ms") + 700 * F.col("seq")).alias("start_ms"), (F.col("end_ms") + 700 * F.col("seq")).alias("end_ms"))


def _envelopes(s, d):
    """Events as envelopes: two signals in a live one."""
    one = F.struct(F.col("signal_id").cast("string").alias("signal_id"), F.col("call_id").cast("string").alias("call_id"), F.col("signal_type").alias("type"), "severity", "confidence")
    return events(s, d).select(F.to_json(F.struct(F.when(F.col("signal_id") % 4 > 0, "live").otherwise("other").alias("kind"), F.col("call_id").cast("string").alias("call_id"), F.array(one).alias("signals"))).alias("value"))


def queries() -> dict:
    return {
        "check_call_id": lambda s, d: contracts.check_call_id(_named(s, d), "stream").select("signal_id", "call_id", F.coalesce("reason", F.lit("")).alias("reason")),
        "unknown_fields": lambda s, d: contracts.unknown_fields(table(s, d, "events"), "props", ["id"]).select("event_id", F.array_join("unknown", ",").alias("unknown")),
        "signal_reasons": lambda s, d: contracts.validate_signals(
            events(s, d).select("signal_id", F.when(F.col("signal_id") % 9 > 0, F.col("signal_type")).otherwise("").alias("label"), (F.col("confidence") * 1.1).alias("confidence"), F.when(F.col("signal_id") % 11 > 0, F.array("signal_id")).alias("evidence"),
                                F.lit(5).alias("window_start_ms"), F.expr("cast(signal_id % 60 as int)").alias("window_end_ms"))
        ).select("signal_id", F.array_join("reasons", ",").alias("reasons")),
        "label_speakers": lambda s, d: conversation.label_speakers(_late(s, d), conversation.index_turns(turns(s, d))).select("call_id", "seq", "speaker"),
        "required_disclosures": lambda s, d: conversation.required_disclosures(_intents(s, d), _scoped(s), ["P0"]),
        "action_items": lambda s, d: conversation.action_items(turns(s, d), [(PROMISE, "agent")], "^(?:zz|a)", 8),
        "route_insights": lambda s, d: route_insights(_envelopes(s, d))[0].select("call_id", "signal_id", "signal_type", "severity"),
        "digit_streams": lambda s, d: pii.digit_streams(documents(s, d)).select("call_id", F.length("digits").alias("digits"), F.size("breaks").alias("breaks")),
        "digit_runs": lambda s, d: pii.pii_spans(documents(s, d), ["digit_runs"]),
        "quotes": lambda s, d: signals.with_quotes(pii.pii_spans(documents(s, d), ["email"]), documents(s, d)).select("call_id", "start", "quote"),
        "ground_claims": _claims,
        "build_signals": lambda s, d: _signals(s, d).select("call_id", "signal_type", "label", "severity", "confidence", "policy_id", F.array_join("evidence", ",").alias("evidence")),
        "judge_calls": lambda s, d: _judged(s, d).withColumn("evidence", F.array_join("evidence", ",")).withColumn("policy_id", F.coalesce("policy_id", F.lit(""))),
        "suppress_repeats": lambda s, d: signals.suppress_repeats(_repeats(s, d)),
        "search_policies": lambda s, d: signals.search_policies(turns(s, d).select((F.col("call_id") * 1000 + F.col("seq")).alias("query_id"), F.col("text").alias("query")), _policies(s), 2),
        "sentiment_shift": lambda s, d: signals.sentiment_shift(plans._sentiment(s, d)),
        "summarize_calls": _summaries,
        "find_leaks": lambda s, d: _leaks(s, d).select("call_id", F.md5("value").alias("value"), "space"),
        "leak_rate": lambda s, d: scoring.leak_rate(_leaks(s, d)),
        "span_coverage": lambda s, d: _coverage(s, d).select("call_id", "start", "end", "covered", "type_correct"),
        "redaction_scorecard": lambda s, d: scoring.redaction_scorecard(_coverage(s, d)),
        "false_positives": lambda s, d: scoring.false_positives(pii.pii_spans(documents(s, d), [*KINDS, "long_digits"]), _labels(s, d)),
        "citation_validity": lambda s, d: scoring.citation_validity(_quotes(s, d), turns(s, d)).select("id", "valid"),
        "evidence_rate": lambda s, d: scoring.evidence_rate(_signals(s, d).withColumn("evidence", F.when(F.col("call_id") % 4 > 0, F.col("evidence"))), ["signal_type"]),
        "action_recall": lambda s, d: scoring.action_recall(
            turns(s, d).where("speaker = 'customer'").select((F.col("call_id") * 1000 + F.col("seq")).alias("id"), "call_id", F.substring("text", 1, 60).alias("item")),
            turns(s, d).where("speaker = 'agent'").select("call_id", F.col("text").alias("description")),
        ),
    }


def oracle_sql() -> dict:
    own = plans.base_sql()
    spans = " union all ".join(f"select call_id, seq, type, start, \"end\" from ({own[f'pii_{k}']})" for k in KINDS)
    norm = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '^[ .,!?…]+|[ .,!?…]+$', '', 'g'), '\\s+', ' ', 'g'))"
    policies = ", ".join(str(p) for p in POLICIES)
    stop = ", ".join(f"'{w}'" for w in signals.STOPWORDS)
    terms = lambda c: f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z]+')), lambda w: w not in ({stop}))"
    values = " union all ".join(f"select doc_id as call_id, unnest(regexp_extract_all(text, '{pii.DETECTORS[k][2]}')) as value from documents" for k in KINDS)
    words = "[" + ", ".join(f"'{w}'" for w in scoring.DIGIT_WORDS) + "]"
    leaks = f"""(select call_id, value, case when length(d) >= 5 then case when contains(e, d) then 'digits' when contains(sp, array_to_string(list_transform(regexp_extract_all(d, '.'), lambda x: {words}[x::int + 1]), ' ')) then 'spoken' else '' end
 when (contains(value, '@') or (d = '' and length(trim(value)) >= 5)) and contains(scrubbed, trim(value)) then 'raw' else '' end as space
 from (select *, regexp_replace(value, '[^0-9]', '', 'g') as d from ({values})) join (select *, regexp_replace(scrubbed, '[^0-9]', '', 'g') as e, trim(regexp_replace(lower(scrubbed), '[^a-z0-9]+', ' ', 'g')) as sp
 from (select doc_id as call_id, {plans.SCRUBBED} as scrubbed from documents)) using (call_id))"""
    narrow = f"(select call_id, seq, case when call_id % 5 = 0 then 'ACCOUNT' else type end as type, case when call_id % 3 = 0 then start + 2 else start end as start, \"end\" from ({spans}))"
    chars = """select call_id, start, "end", type, p, regexp_matches(substring(text, (p + 1)::bigint, 1), '[0-9]') as digit from (select *, unnest(range(start, "end")) as p from ({spans})) join documents on doc_id = call_id"""
    chars = chars.replace("{spans}", spans)
    coverage = f"""(with c as ({chars}), h as (select c.*, exists (select 1 from {narrow} n where n.call_id = c.call_id and n.start <= c.p and c.p < n."end") as hit from c),
 g as (select call_id, start, "end", type, case when bool_or(digit) then bool_and(hit or not digit) else count(*) filter (hit) / count(*) >= 0.9 end as covered from h group by all)
 select g.*, covered and coalesce((select arg_min(n.type, (n.start, n."end", n.type)) from {narrow} n where n.call_id = g.call_id and n.start < g."end" and g.start < n."end") = g.type, false) as type_correct from g)"""
    risk = own["escalation_risk"]
    sig = f"""(select call_id, '{signals.VIOLATION}' as signal_type, phrase as label, 'high' as severity, 0.89::double as confidence, policy_id, seq::varchar as evidence from ({own['compliance_hits']})
 union all select call_id, '{signals.VIOLATION}', 'missing', case policy_id when 'P1' then 'critical' else 'medium' end, case policy_id when 'P1' then 0.9 when 'P2' then 0.765 else 0.75 end, policy_id, anchor::varchar from ({own['disclosure_status']}) where not given
 union all select r.call_id, '{signals.ESCALATION}', h.label, r.band, r.risk, null, h.evidence from ({risk}) r join (select call_id, arg_min(label, (-weight, seq, label)) as label, array_to_string(list(seq order by seq, label)[1:3], ',') as evidence from ({own['escalation_hits']}) group by 1) h on r.call_id = h.call_id where band in ('medium', 'high'))"""
    actions = f"""(select call_id, string_agg(seq || ':' || description, ',' order by seq, description) as action_items from (select *, row_number() over (partition by call_id order by seq, description) as n
 from (%ACTIONS%)) where n <= {signals.MOST_ACTIONS} group by 1)"""
    listed = lambda q, n: f"(select call_id, string_agg(policy_id, ',' order by policy_id) as {n} from (select distinct call_id, policy_id from ({q})) group by 1)"
    broken = f"select call_id, policy_id from ({own['compliance_hits']}) where policy_id = 'P3' union all select call_id, policy_id from ({own['disclosure_status']}) where not given"
    id_ = "call_id * 1000 + seq"
    found = {
        "check_call_id": f"select signal_id, case when signal_id % 5 > 0 and signal_id % 7 = 0 then 'x' else call_id::varchar end as call_id, case when signal_id % 5 > 0 and signal_id % 7 = 0 then 'call_id_mismatch' else '' end as reason from {SIGNALS_SQL}",
        "unknown_fields": "select event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k <> 'id')), ',') as unknown from events",
        "signal_reasons": f"select signal_id, array_to_string(list_filter([case when signal_id % 9 = 0 then 'label' end, case when not (confidence * 1.1 between 0 and 1) then 'confidence' end, case when signal_id % 11 = 0 then 'evidence' end, case when signal_id % 60 < 5 then 'window' end], lambda x: x is not null), ',') as reasons from {SIGNALS_SQL}",
        "label_speakers": f"""with s as (select call_id, seq, start_ms + 700 * seq as a, end_ms + 700 * seq as b from {TURNS_SQL}), t as (select * from {TURNS_SQL})
 select s.call_id, s.seq, coalesce((select arg_min(t.speaker, (case when (a + b) // 2 between t.start_ms and t.end_ms then 0 else 1 end, case when (a + b) // 2 between t.start_ms and t.end_ms then 0 else greatest(a, t.start_ms) - least(b, t.end_ms) end, t.seq))
 from t where t.call_id = s.call_id and ((a + b) // 2 between t.start_ms and t.end_ms or least(b, t.end_ms) > greatest(a, t.start_ms))), 'unknown') as speaker from s""",
        "required_disclosures": f"""select distinct call_id, policy_id from (select call_id, 'P0' as policy_id from ({own['intents']}) union all
 select call_id, p from ({own['intents']}) join (values ('P1', 'the_topic'), ('P2', 'in_topic'), ('P2', 'other')) v(p, i) on i = primary_intent or list_contains(string_split(secondary, ','), i))""",
        "action_items": f"""select call_id, seq, description, 'agent' as owner from (select call_id, arg_min(seq, (seq, place)) as seq, arg_min(item, (seq, place)) as description from
 (select call_id, seq, unnest(v) as item, unnest(range(len(v))) as place from (select *, regexp_extract_all(text, '{PROMISE}', 1) as v from {TURNS_SQL} where speaker = 'agent')) where length(item) >= 8 and not regexp_matches(item, '^(?:zz|a)') group by call_id, lower(item))""",
        "route_insights": f"select call_id::varchar as call_id, signal_id::varchar as signal_id, signal_type, severity from {SIGNALS_SQL} where signal_id % 4 > 0",
        "quotes": f"""select call_id, start, case when lo > 0 then '...' else '' end || regexp_replace(substring(text, lo + 1, hi - lo), '^\\s+|\\s+$', '', 'g') || case when hi < length(text) then '...' else '' end as quote
 from (select call_id, start, text, greatest(0, start - 45) as lo, least(length(text), "end" + 45) as hi from ({own['pii_email']}) join documents on doc_id = call_id)""",
        "ground_claims": f"""select signal_id, case when t.call_id is null then 'no_turn' when signal_type = 'click' and policy_id not in ('P0', 'P1', 'P2', 'P3') then 'no_policy' else '' end as reason, md5(coalesce(left(t.text, 500), '')) as quote
 from {SIGNALS_SQL} s left join {TURNS_SQL} t on t.call_id = s.call_id and t.seq = s.signal_id % 6""",
        "build_signals": f"select * from {sig}",
        "evidence_rate": f"select signal_type, count(*) as total, count(*) filter (call_id % 4 = 0) as without_evidence, round(avg((call_id % 4 > 0)::int), 4) as evidence_rate from {sig} group by 1",
        "search_policies": f"""select query_id, policy_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, place) as rank from
 (select query_id, policy_id, place, round(len(list_intersect(q, p)) / len(q), 6) as score from (select {id_} as query_id, {terms('text')} as q from {TURNS_SQL}), (select policy_id, place, {terms('text')} as p from (values {policies}) v(policy_id, place, text)) where len(list_intersect(q, p)) > 0)) where rank <= 2""",
        "sentiment_shift": f"""select call_id, case when delta < 0 then 'negative_shift' else 'positive_shift' end as label, round(delta, 3) as delta, case when delta < 0 then low else high end as anchor from (select call_id,
 avg(sentiment) filter (k > n - n // 2) - avg(sentiment) filter (k <= n // 2) as delta, arg_min(seq, (sentiment, seq)) filter (k > n - n // 2) as low, arg_min(seq, (-sentiment, seq)) filter (k > n - n // 2) as high
 from (select *, row_number() over (partition by call_id order by seq) as k, count(*) over (partition by call_id) as n from {plans.SENTIMENT_SQL} where speaker = 'customer') where n >= 3 group by 1) where abs(delta) >= 0.35""",
        "summarize_calls": f"""select call_id, primary_intent, secondary, resolution, coalesce(start, 0.0) as sentiment_start, coalesce("end", 0.0) as sentiment_end, escalated, coalesce(violations, '') as violations, coalesce(disclosures, '') as disclosures,
 'The customer called about ' || replace(primary_intent, '_', ' ') || ' over ' || turn_count || ' turns.' || case when escalated then ' The call was escalated to a supervisor before it concluded.' when resolution = 'resolved' then ' The agent resolved the issue on the call.'
 when resolution = 'follow_up_required' then ' The agent committed to follow-up action after the call.' else ' The issue was not settled during the call.' end as summary, coalesce(action_items, '') as action_items, seq as evidence
 from (select f.*, a.action_items, r.seq, i.* exclude (call_id), m.* exclude (call_id), v.* exclude (call_id), g.* exclude (call_id), coalesce(up, false) as escalated, case when coalesce(up, false) then 'escalated' else r.resolution end as resolution
 from ({own['call_facts']}) f left join ({own['intents']}) i using (call_id) left join ({own['resolution']}) r using (call_id) left join ({own['sentiment_endpoints']}) m using (call_id)
 left join (select call_id, bool_or(label = 'of_the') as up from ({own['escalation_hits']}) group by 1) u using (call_id) left join {listed(broken, 'violations')} v using (call_id)
 left join {listed(f"select * from ({own['disclosure_status']}) where given", 'disclosures')} g using (call_id) left join {actions} a using (call_id))""",
        "find_leaks": f"select call_id, md5(value) as value, space from {leaks}",
        "leak_rate": f"select count(*) as values, count(*) filter (space <> '') as leaked, round(count(*) filter (space <> '') / count(*), 6) as leak_rate from {leaks}",
        "span_coverage": f'select call_id, start, "end", covered, type_correct from {coverage}',
        "redaction_scorecard": f"select type, count(*) filter (covered) as tp, count(*) filter (not covered) as fn, round(count(*) filter (covered) / count(*), 6) as recall, round(count(*) filter (type_correct) / nullif(count(*) filter (covered), 0), 6) as type_accuracy from {coverage} group by 1",
        "false_positives": f"""select type, count(*) as false_positives from ({spans} union all select call_id, seq, type, start, "end" from ({own['pii_long_digits']})) s
 where not exists (select 1 from ({spans}) t where t.call_id = s.call_id and t.start < s."end" and s.start < t."end") group by 1""",
        "citation_validity": f"""with q as (select {id_} as id, call_id, {norm("replace('...' || substring(text, 5, 30) || '...' || case when call_id % 3 = 0 then ' zzz' else '' end, '...', ' ')")} as q from {TURNS_SQL})
 select id, length(q) < 8 or exists (select 1 from {TURNS_SQL} t where t.call_id = q.call_id and contains({norm('t.text')}, q.q)) as valid from q""",
        "action_recall": f"""with l as (select {id_} as id, call_id, list_filter(string_split({norm('substring(text, 1, 60)')}, ' '), lambda w: length(w) > 4) as w from {TURNS_SQL} where speaker = 'customer'),
 f as (select l.*, len(w) > 0 and exists (select 1 from {TURNS_SQL} t where t.call_id = l.call_id and t.speaker = 'agent' and len(list_filter(w, lambda x: contains({norm('t.text')}, x))) >= greatest(1, len(w) // 2)) as hit from l)
 select call_id, count(*) as items, count(*) filter (hit) as found, round(count(*) filter (hit) / count(*), 6) as recall from f group by 1""",
    }
    found["summarize_calls"] = found["summarize_calls"].replace("%ACTIONS%", found["action_items"])
    found["judge_calls"] = f"""with s as ({found['build_signals']}), fast as (select call_id, signal_type, label, severity, policy_id, evidence, case when signal_type = '{signals.ESCALATION}' then confidence
  when label = 'missing' then case policy_id when 'P1' then 0.9 when 'P2' then round(0.55 + 0.55 * 0.35, 3) else round(0.55 + 0.5 * 0.35, 3) end else 0.88 end as confidence,
  case when signal_type = '{signals.ESCALATION}' then 2 when label = 'missing' then 1 else 0 end as kind from s where not (coalesce(policy_id, '') = 'P3' and call_id % 3 = 0)),
 c as (select * from fast union all by name select call_id, '{signals.SHIFT}' as signal_type, label, case when abs(delta) > 0.6 then 'medium' else 'low' end as severity, round(least(0.9, abs(delta)), 3) as confidence,
  null as policy_id, anchor::varchar as evidence, 3 as kind from ({found['sentiment_shift']})
  union all by name select e.call_id, '{signals.INTENT}' as signal_type, e.intent as label, 'info' as severity, 0.7 as confidence, null as policy_id, e.seq::varchar as evidence, 4 as kind
  from (%EVIDENCE%) e join ({own['intents']}) p on p.call_id = e.call_id and p.primary_intent = e.intent)
 select call_id, signal_type, label, severity, confidence, coalesce(policy_id, '') as policy_id, evidence, place::int as place from (select *, row_number() over (partition by call_id order by kind, string_split(evidence, ',')[1]::int, policy_id nulls first, label) as place from c)
 where place <= {signals.MOST_SIGNALS}"""
    return found
