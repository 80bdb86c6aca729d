"""The shipped rules over calls: every turn carries one of some planted sentences. Queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope import plans, rules
from callscope.operators import conversation
from callscope.testdata import TURNS_SQL, turns

#: What the turns say beside their prose, so that the shipped words are met.
SENTENCES = [
    "I want to speak to a supervisor, this is ridiculous.", "Thank you so much, that worked and I am very happy.", "I'll go ahead and send the new card today.",
    "I am not happy, nobody will help me and I was never called.", "I don't recognise this charge, I want a refund of the fee.", "You'll hear back within five business days.",
    "We'll review the account and call you back.", "My lawyer says this is the third time I have asked, put it in writing.", "I can't pay my balance, can we make a payment plan?",
    "I'm crediting the service charge now.", "It is absolutely terrible, the app crashes again.", "You'll need to reset the password on the website.", "Let me check that.",
]


def said(s, d):
    """Turns with a sentence chosen by call and place."""
    at = F.pmod(F.col("call_id") * 7 + F.col("seq") * 3, F.lit(len(SENTENCES))).cast("int") + 1
    return turns(s, d).withColumn("text", F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, SENTENCES)), at)))


SAID_SQL = f"(select * replace (text || ' ' || ({plans.sql_list(SENTENCES)})[(call_id * 7 + seq * 3) % {len(SENTENCES)} + 1] as text) from {TURNS_SQL})"


def _mood(s, d):
    return conversation.score_sentiment(said(s, d), rules.MOOD_WORDS, rules.NEGATIONS, rules.INTENSIFIERS, 3, rules.MOOD_PHRASES)


def _hits(s, d):
    return conversation.pattern_hits(said(s, d), rules.ESCALATION)


def queries() -> dict:
    return {
        "rules_sentiment": lambda s, d: _mood(s, d).select("call_id", "seq", F.round("sentiment", 8).alias("sentiment")),
        "rules_escalation": lambda s, d: _hits(s, d).select("call_id", "seq", "label", "weight"),
        "rules_risk": lambda s, d: conversation.escalation_risk(said(s, d), _hits(s, d), _mood(s, d)),
        "rules_escalated": lambda s, d: conversation.escalated_flag(_hits(s, d), rules.ESCALATED_LABELS),
        "rules_intents": lambda s, d: conversation.score_intents(said(s, d), rules.INTENTS),
        "rules_resolution": lambda s, d: conversation.classify_resolution(
            said(s, d), rules.FOLLOW_UP, rules.RESOLVED, conversation.escalated_flag(_hits(s, d), rules.ESCALATED_LABELS), rules.ESCALATED
        ),
        "rules_actions": lambda s, d: conversation.action_items(said(s, d), rules.ACTIONS, rules.ACTION_NOISE),
    }


def oracle_sql() -> dict:
    mood = plans.sentiment_sql(SAID_SQL, rules.MOOD_WORDS, rules.NEGATIONS, rules.INTENSIFIERS, rules.MOOD_PHRASES)
    hits = plans.hits_sql(SAID_SQL, rules.ESCALATION)
    up = f"select call_id, bool_or(list_contains({plans.sql_list(rules.ESCALATED_LABELS)}, label)) as escalated from ({hits}) group by 1"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    phrases = ", ".join(f"({quote(i)}, {quote(p)}, {w}::double)" for i, own in rules.INTENTS.items() for p, w in own.items())
    items = []
    for k, (pattern, owner) in enumerate(rules.ACTIONS):
        groups = 2 if "(escalating" in pattern or "(request|" in pattern else 1
        item = " || ' ' || ".join(f"regexp_extract_all(text, {quote(pattern)}, {g})[i]" for g in range(1, groups + 1))
        items.append(f"select call_id, seq, {k} as pattern, i as place, trim({item}, ' .,') as item, '{owner}' as owner from (select *, unnest(range(1, len(regexp_extract_all(text, {quote(pattern)})) + 1)) as i from {SAID_SQL} where speaker = 'agent')")
    return {
        "rules_sentiment": f"select call_id, seq, round(sentiment, 8) as sentiment from {mood}",
        "rules_escalation": hits,
        "rules_risk": plans.risk_sql(SAID_SQL, hits, mood),
        "rules_escalated": up,
        "rules_intents": f"""select call_id, intent, round(sum(w * case when speaker = 'customer' then 1.0 else 0.45 end * (1.0 - 0.5 * idx / n)), 6) as score
 from (select *, row_number() over (partition by call_id order by seq) - 1 as idx, count(*) over (partition by call_id) as n from {SAID_SQL}) join (values {phrases}) k(intent, phrase, w) on contains(lower(text), phrase) group by 1, 2""",
        "rules_resolution": plans.resolution_sql(SAID_SQL, rules.FOLLOW_UP, rules.RESOLVED, f"select call_id from ({up}) where escalated", rules.ESCALATED),
        "rules_actions": f"""select call_id, arg_min(seq, (seq, pattern, place)) as seq, arg_min(item, (seq, pattern, place)) as description, arg_min(owner, (seq, pattern, place)) as owner
 from ({' union all '.join(items)}) where length(item) >= 6 and not regexp_matches(item, {quote(rules.ACTION_NOISE)}) group by call_id, lower(item)""",
    }
