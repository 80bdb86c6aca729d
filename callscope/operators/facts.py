"""Insights as rows of the three fact tables, and stored rows as insights again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators.contracts import with_trace_id

#: Stages of a latency row and the field that holds each.
STAGES = {
    "asr": "asr_ms", "redact": "redact_ms", "ingest": "ingest_ms", "queue": "queue_ms", "analyze": "analyze_ms", "llm": "llm_ms",
    "e2e": "segment_to_signal_ms",
}
EVIDENCE = ("seq", "start_ms", "end_ms", "speaker", "quote")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _agent(envelope_agent: Column | None) -> Column:
    own = F.when(_text("agent_id") != "", F.col("agent_id").cast("string"))
    return F.coalesce(own, envelope_agent, F.lit("")) if envelope_agent is not None else F.coalesce(own, F.lit(""))


def _field(name: str):
    return lambda struct: struct[name]


def to_signal_rows(signals: DataFrame, envelope_agent: Column | None = None) -> DataFrame:
    """Signals (evidence as structs, ``latency`` as a struct) as flat rows: evidence in five parallel arrays, missing ids empty.

    An agent that the signal lacks is that of its envelope. A stage that did not run stays null.
    """
    evidence = F.coalesce("evidence", F.array().cast(signals.schema["evidence"].dataType))
    return with_trace_id(signals).select(
        "signal_id", "call_id", _agent(envelope_agent).alias("agent_id"), "signal_type", "label", "severity", _text("policy_id").alias("policy_id"),
        F.col("confidence").cast("double").alias("confidence"), "rationale", "emitted_at", "window_start_ms", "window_end_ms",
        *[F.transform(evidence, _field(name)).alias(f"evidence_{name}") for name in EVIDENCE],
        *[F.col(f"latency.{field}").alias(f"latency_{field}") for field in STAGES.values()],
        "model_name", "prompt_version", F.coalesce("trace_id", F.lit("")).alias("trace_id"),
    )


def to_latency_rows(signals: DataFrame, envelope_agent: Column | None = None) -> DataFrame:
    """One row a stage that ran, under the turn of the first evidence (0 without any)."""
    seq = F.coalesce(F.get("evidence", F.lit(0))["seq"], F.lit(0))
    ran = F.array(*[F.struct(F.lit(stage).alias("stage"), F.col(f"latency.{field}").cast("double").alias("duration_ms")) for stage, field in STAGES.items()])
    rows = signals.select("call_id", seq.alias("seq"), _agent(envelope_agent).alias("agent_id"), "emitted_at", F.explode(ran).alias("s"))
    return rows.where("s.duration_ms is not null").select("call_id", "seq", "agent_id", "s.stage", "s.duration_ms", F.lit(1).alias("is_final"), "emitted_at")


def to_summary_rows(summaries: DataFrame, facts: DataFrame | None = None, envelope_agent: Column | None = None) -> DataFrame:
    """Summaries as flat rows; turns, duration, redactions and start come from ``facts`` (call_id, ...) where it has them.

    Without facts the counts are 0 and a call starts when it ends. Derived: sentiment_delta, violation_count, ended_date.
    """
    rows = summaries if facts is None else summaries.join(facts.select("call_id", *[c for c in ("turn_count", "duration_ms", "redaction_count", "started_at") if c in facts.columns]), "call_id", "left")
    count = lambda c: (F.coalesce(c, F.lit(0)) if c in rows.columns else F.lit(0)).cast("int").alias(c)
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    started = F.coalesce("started_at", "emitted_at") if "started_at" in rows.columns else F.col("emitted_at")
    items = F.coalesce("action_items", F.array().cast(summaries.schema["action_items"].dataType))
    flat = with_trace_id(rows).select(
        "call_id", _agent(envelope_agent).alias("agent_id"), "primary_intent", listed("secondary_intents"), "resolution",
        F.coalesce("escalated", F.lit(False)).cast("int").alias("escalated"), "summary",
        F.col("customer_sentiment_start").cast("double").alias("sentiment_start"), F.col("customer_sentiment_end").cast("double").alias("sentiment_end"),
        listed("compliance_violations"), listed("disclosures_given"),
        F.transform(items, _field("description")).alias("action_items"), F.transform(items, _field("owner")).alias("action_item_owners"),
        count("turn_count"), count("duration_ms"), count("redaction_count"), started.alias("started_at"), F.col("emitted_at").alias("ended_at"),
        "model_name", "prompt_version", F.coalesce("trace_id", F.lit("")).alias("trace_id"),
    )
    return flat.withColumns({
        "sentiment_delta": F.col("sentiment_end") - F.col("sentiment_start"),
        "violation_count": F.size("compliance_violations"),
        "ended_date": F.to_date("ended_at"),
    })


def evidence_structs(rows: DataFrame) -> DataFrame:
    """Stored signal rows with ``evidence`` as structs again; what a shorter array lacks is 0, ``unknown`` or empty. An empty policy is null."""
    none = {"start_ms": F.lit(0), "end_ms": F.lit(0), "speaker": F.lit("unknown"), "quote": F.lit("")}
    at = lambda i, c: F.coalesce(F.get(f"evidence_{c}", i), none[c]).alias(c)
    spans = F.transform(F.coalesce("evidence_seq", F.array().cast("array<int>")), lambda seq, i: F.struct(seq.alias("seq"), *[at(i, c) for c in none]))
    policy = F.when(F.col("policy_id") != "", F.col("policy_id"))
    return rows.withColumn("evidence", spans).withColumn("policy_id", policy).drop(*[f"evidence_{c}" for c in EVIDENCE])
