"""Call summaries and envelopes: contract checks, and the coercion of raw summaries into the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.conversation import index_turns

#: The contract's enumerations and bounds.
RESOLUTIONS = ("resolved", "unresolved", "escalated", "follow_up_required")
OWNERS = ("agent", "customer", "supervisor", "system")
KINDS = ("live", "post_call")
MAX_ITEMS, MAX_SECONDARY, MAX_POLICIES, MAX_EVIDENCE = 20, 5, 20, 40
MAX_DESCRIPTION, MAX_SUMMARY, MAX_NAME = 500, 2000, 64
DEFAULT_INTENT, NO_SUMMARY = "general_inquiry", "No summary produced."


def _reasons(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``reasons``: names of the rules (name, column, SQL that must hold) that a row breaks. Missing columns are not judged."""
    broken = [F.when(~F.coalesce(F.expr(test), F.lit(False)), F.lit(name)) for name, column, test in rules if column in df.columns]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def validate_summaries(summaries: DataFrame) -> DataFrame:
    """Adds ``reasons``; a null list counts as empty, any other null breaks its rule."""
    at_most = lambda c, n: (c, c, f"coalesce(size({c}), 0) <= {n}")
    mood = lambda c: (c, c, f"try_cast({c} as double) between -1 and 1")
    return _reasons(
        summaries,
        [
            ("call_id", "call_id", f"length(cast(call_id as string)) between 1 and {MAX_NAME}"),
            ("summary", "summary", f"length(summary) between 1 and {MAX_SUMMARY}"),
            ("resolution", "resolution", f"resolution in {RESOLUTIONS}"),
            ("primary_intent", "primary_intent", f"length(primary_intent) between 1 and {MAX_NAME}"),
            at_most("secondary_intents", MAX_SECONDARY),
            at_most("action_items", MAX_ITEMS),
            ("items", "action_items", f"""forall(coalesce(action_items, array()), i -> coalesce(length(i.description) between 1 and {MAX_DESCRIPTION}
             and i.owner in {OWNERS} and size(i.evidence) > 0, false))"""),
            mood("customer_sentiment_start"),
            mood("customer_sentiment_end"),
            at_most("compliance_violations", MAX_POLICIES),
            at_most("disclosures_given", MAX_POLICIES),
            at_most("evidence", MAX_EVIDENCE),
        ],
    )


def validate_envelopes(envelopes: DataFrame) -> DataFrame:
    """Adds ``reasons``: a live envelope holds signals, a post-call one a summary."""
    return _reasons(
        envelopes,
        [
            ("kind", "kind", f"kind in {KINDS}"),
            ("call_id", "call_id", f"length(cast(call_id as string)) between 1 and {MAX_NAME}"),
            ("emitted_at", "emitted_at", "emitted_at is not null"),
            ("signals", "signals", "coalesce(kind, '') <> 'live' or size(signals) > 0"),
            ("payload", "summary", "coalesce(kind, '') <> 'post_call' or summary is not null"),
        ],
    )


def _clamped(column: str):
    """Within [-1, 1]; what is no number counts 0."""
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.expr(f"try_cast({column} as double)"))), F.lit(0.0))


def _known(column: str, allowed: list[str]):
    stripped = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda v: F.trim(v))
    return F.filter(stripped, lambda v: v.isin(*allowed) if allowed else F.lit(False))


def coerce_summaries(raw: DataFrame, intents: list[str], policies: list[str], turns: DataFrame) -> DataFrame:
    """Raw summaries, one a call, in the contract's shape, with ``reason`` where one must be rejected.

    Evidence names turns by their place in the call; an action item of which no
    place exists, or without a description, goes. Only the turns that some item
    names are joined, and the twenty items of a call bound what is gathered.
    Needs call_id, summary, primary_intent, secondary_intents, resolution, both
    sentiments (as text), compliance_violations, disclosures_given, and
    action_items (array of description, owner, due, evidence_turns). A null
    call_id keeps no item; an unknown intent or resolution is the reason.
    """
    listed = raw.select("call_id", F.posexplode(F.slice("action_items", 1, MAX_ITEMS)).alias("place", "i"))
    named = listed.select(
        "call_id", "place", F.substring(F.trim("i.description"), 1, MAX_DESCRIPTION).alias("description"), F.lower(F.trim("i.owner")).alias("owner"),
        F.col("i.due").alias("due"), F.posexplode(F.slice("i.evidence_turns", 1, MAX_EVIDENCE)).alias("nth", "turn"),
    ).where("length(description) > 0")
    spans = index_turns(turns).select("call_id", "idx", F.struct("seq", "start_ms", "end_ms", "speaker").alias("span"))
    sourced = named.withColumn("idx", F.expr("try_cast(turn as int)")).join(spans, ["call_id", "idx"])
    items = sourced.groupBy("call_id", "place", "description", "owner", "due").agg(F.array_sort(F.collect_list(F.struct("nth", "span"))).alias("e"))
    owner = F.when(F.col("owner").isin(*OWNERS), F.col("owner")).otherwise("agent").alias("owner")
    item = F.struct("place", "description", owner, "due", F.transform("e", lambda x: x["span"]).alias("evidence"))
    items = items.groupBy("call_id").agg(F.array_sort(F.collect_list(item)).alias("__items"))

    intent = F.coalesce(F.nullif(F.trim("primary_intent"), F.lit("")), F.lit(DEFAULT_INTENT))
    resolution = F.coalesce(F.trim("resolution"), F.lit(""))
    reason = F.when(~intent.isin(*intents), "primary_intent").when(~resolution.isin(*RESOLUTIONS), "resolution")
    policy = lambda c: F.array_sort(F.array_distinct(_known(c, policies)))
    out = raw.join(items, "call_id", "left")
    return out.select(
        "call_id",
        reason.alias("reason"),
        F.coalesce(F.nullif(F.substring(F.trim("summary"), 1, MAX_SUMMARY), F.lit("")), F.lit(NO_SUMMARY)).alias("summary"),
        intent.alias("primary_intent"),
        F.slice(F.filter(_known("secondary_intents", intents), lambda v: v != intent), 1, MAX_SECONDARY).alias("secondary_intents"),
        resolution.alias("resolution"),
        _clamped("customer_sentiment_start").alias("customer_sentiment_start"),
        _clamped("customer_sentiment_end").alias("customer_sentiment_end"),
        policy("compliance_violations").alias("compliance_violations"),
        policy("disclosures_given").alias("disclosures_given"),
        F.coalesce(F.transform("__items", lambda x: x.dropFields("place")), F.array()).alias("action_items"),
    )
