"""Segment contracts: checks with reasons, dedupe, outcomes and small row fixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPEAKERS = ("customer", "agent", "unknown")
MAX_TEXT_BYTES, MAX_REDACTIONS, MAJOR = 8192, 256, "1"


def validate_segments(segments: DataFrame) -> DataFrame:
    """Adds ``reasons``: the name of every broken rule; an empty array passes. Missing columns are not judged."""
    has = set(segments.columns)
    rules = [
        ("call_id", "call_id", "call_id is null or length(cast(call_id as string)) not between 1 and 64"),
        ("seq", "seq", "seq is null or seq < 0"),
        ("speaker", "speaker", f"speaker is null or speaker not in {SPEAKERS}"),
        ("text", "text", f"text is null or octet_length(text) > {MAX_TEXT_BYTES}"),
        ("utf8", "text", "not is_valid_utf8(text)"),
        ("times", "start_ms", "start_ms is null or end_ms is null or start_ms < 0 or end_ms < start_ms"),
        ("confidence", "asr_confidence", "asr_confidence not between 0 and 1"),
        ("emitted_at", "emitted_at", "emitted_at is null"),
        ("version", "schema_version", f"coalesce(schema_version, '') <> '' and split_part(schema_version, '.', 1) <> '{MAJOR}'"),
        ("redactions", "redactions", f"size(redactions) > {MAX_REDACTIONS}"),
        ("spans", "redactions", "exists(redactions, r -> not (r.start >= 0 and r.end > r.start and r.end <= length(text) and substring(text, r.start + 1, r.end - r.start) = r.placeholder and r.placeholder rlike '^<[A-Z_]+_[0-9]+>$' and r.confidence between 0 and 1))"),
    ]
    found = [F.when(F.coalesce(F.expr(test), F.lit(False)), F.lit(name)) for name, column, test in rules if column in has]
    return segments.withColumn("reasons", F.array_compact(F.array(*found)))


def is_compatible(column: str) -> Column:
    """Whether a version has the major number that this library reads; a missing one counts as such."""
    version = F.coalesce(column, F.lit(""))
    return (version == "") | (F.split_part(version, F.lit("."), F.lit(1)) == MAJOR)


def compatible(segments: DataFrame, column: str = "schema_version") -> DataFrame:
    """Rows of a version that this library reads; a row without a version is readable, for every reader alike."""
    return segments.where(is_compatible(column))


def _row_tie(df: DataFrame) -> Column:
    """Tells rows apart that arrive together, whatever their order."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])))


def dedupe_segments(segments: DataFrame, arrival: str = "emitted_at") -> DataFrame:
    """The first arrival of every (call, seq, final or partial); of those that arrive together, one by a hash of the row."""
    w = Window.partitionBy("call_id", "seq", "is_final").orderBy(arrival, _row_tie(segments))
    return segments.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def latest_hypothesis(segments: DataFrame) -> DataFrame:
    """The final of every (call, seq), else its newest partial; of those emitted together, one by a hash of the row."""
    w = Window.partitionBy("call_id", "seq").orderBy(F.col("is_final").desc(), F.col("emitted_at").desc(), _row_tie(segments))
    return segments.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def ingest_outcomes(segments: DataFrame, arrival: str) -> DataFrame:
    """Counts by outcome (accepted, duplicate, rejected) and first reason; a rejected segment is nothing that another could repeat."""
    w = Window.partitionBy("call_id", "seq", "is_final", F.size("reasons") > 0).orderBy(arrival, "__tie")
    judged = validate_segments(segments).withColumn("__tie", _row_tie(segments)).withColumn("rn", F.row_number().over(w))
    outcome = F.when(F.size("reasons") > 0, "rejected").when(F.col("rn") > 1, "duplicate").otherwise("accepted")
    reason = F.when(F.size("reasons") > 0, F.element_at("reasons", 1)).otherwise("")
    return judged.groupBy(outcome.alias("outcome"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("segments"))


def scrub(df: DataFrame, column: str) -> DataFrame:
    """Email addresses and long digit runs of free text become markers."""
    text = F.regexp_replace(column, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[email]")
    return df.withColumn(column, F.regexp_replace(text, r"\d(?:[ -]?\d){6,}", "[digits]"))


def with_elapsed_ms(df: DataFrame, start: str, end: str) -> DataFrame:
    """Milliseconds between two timestamps; null if negative or over an hour."""
    ms = F.unix_millis(F.col(end).cast("timestamp")) - F.unix_millis(F.col(start).cast("timestamp"))
    return df.withColumn("elapsed_ms", F.when(ms.between(0, 3_600_000), ms))


def with_lenient_ts(df: DataFrame, column: str, arrival: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.try_to_timestamp(column), F.col(arrival)))


def with_trace_id(df: DataFrame, column: str = "traceparent") -> DataFrame:
    parts = F.split(column, "-")
    return df.withColumn("trace_id", F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(""))


def drop_reasons(findings: DataFrame, least: float = 0.35) -> DataFrame:
    """Adds ``dropped``: ``confidence`` for a finding under ``least`` or without one, ``evidence`` for one without evidence, else null."""
    weak = ~F.coalesce(F.col("confidence") >= least, F.lit(False))
    bare = ~F.coalesce(F.size("evidence") > 0, F.lit(False)) if "evidence" in findings.columns else F.lit(False)
    return findings.withColumn("dropped", F.when(weak, "confidence").when(bare, "evidence"))


def drop_weak(findings: DataFrame, least: float = 0.35) -> DataFrame:
    """The findings that ``drop_reasons`` leaves."""
    return drop_reasons(findings, least).where("dropped is null").drop("dropped")


def sequence_gaps(segments: DataFrame) -> DataFrame:
    """(call_id, after, missing) where numbers are missing between a call's segments."""
    w = Window.partitionBy("call_id").orderBy("seq")
    gap = segments.select("call_id", "seq").distinct().withColumn("after", F.lag("seq").over(w))
    return gap.where("seq > after + 1").select("call_id", "after", (F.col("seq") - F.col("after") - 1).alias("missing"))


def check_call_id(segments: DataFrame, stream_id: str) -> DataFrame:
    """The stream's id rules: an empty or null call_id takes it, another one gets the reason ``call_id_mismatch``."""
    own = F.when(F.coalesce("call_id", F.lit("")) == "", F.col(stream_id)).otherwise(F.col("call_id"))
    return segments.withColumn("call_id", own).withColumn("reason", F.when(~F.col("call_id").eqNullSafe(F.col(stream_id)), "call_id_mismatch"))


def unknown_fields(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Adds ``unknown``: sorted top-level keys of a JSON object that are not allowed; null where it is no object."""
    keys = F.json_object_keys(F.when(F.col(column).rlike(r"^\s*\{"), F.col(column)))
    return df.withColumn("unknown", F.array_sort(F.array_except(keys, F.array(*map(F.lit, allowed)).cast("array<string>"))))


def unknown_paths(df: DataFrame, column: str, allowed: list[str], keys: tuple[str, ...]) -> DataFrame:
    """(keys, path): each key of a JSON text that isn't allowed, at any depth, once a row.

    Paths are dotted; ``[]`` stands for an array's elements (``redactions[].type``). Within an object that isn't allowed nothing is
    looked at; nor are keys of an allowed value with no allowed path below it. Texts that aren't JSON give no rows.
    """
    steps = sorted({tuple(p.replace("[]", ".[]").split(".")) for p in allowed}, key=len)
    inner = sorted({".".join(p[:k]).replace(".[]", "[]") for p in steps for k in range(1, len(p))})
    known = sorted({*allowed, *inner})
    spark = df.sparkSession
    level = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(F.col(column).cast("string")).alias("v"))
    parts = []
    for _ in range(max(map(len, steps), default=1)):
        walked = spark.sql("SELECT t.*, e.key AS key, e.value AS value FROM {t} t, LATERAL variant_explode(t.v) e", t=level)
        name = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        walked = walked.select(*keys, name.alias("path"), F.col("value").alias("v"))
        parts.append(walked.where(~F.col("path").isin(known)).select(*keys, "path"))
        level = walked.where(F.col("path").isin(inner))
    return reduce(DataFrame.unionByName, parts).distinct()


#: Kinds and severities of signals, and the most characters of each text field.
SIGNAL_TYPES, SEVERITIES = ("compliance_violation", "escalation_risk", "intent", "sentiment_shift"), ("critical", "high", "medium", "low", "info")
LONGEST = {"signal_id": 64, "call_id": 64, "rationale": 1000, "policy_id": 64, "agent_id": 64, "model_name": 128, "prompt_version": 64}
#: What an evidence span must fulfil, where it is a struct.
EVIDENCE = "e.seq >= 0 and e.start_ms >= 0 and e.end_ms >= 0 and e.speaker in ('customer', 'agent', 'unknown') and length(e.quote) > 0"


def validate_signals(signals: DataFrame) -> DataFrame:
    """Adds ``reasons``: the name of every broken rule; an empty array passes. Missing columns are not judged, but for those first named.

    Signals need an id, a label of 1 to 128 characters, a confidence in [0, 1], evidence, and windows in order; their type and severity
    are of those known, their texts no longer than allowed, their evidence spans whole.
    """
    has = set(signals.columns)
    known = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    bad = {
        "signal_id": F.col("signal_id").isNull() | (F.col("signal_id").cast("string") == ""),
        "label": ~F.coalesce(F.length("label").between(1, 128), F.lit(False)),
        "confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "evidence": ~F.coalesce(F.size("evidence") > 0, F.lit(False)),
        "window": F.coalesce((F.col("window_start_ms") < 0) | (F.col("window_end_ms") < F.col("window_start_ms")), F.lit(False)),
    }
    if "signal_type" in has:
        bad["signal_type"] = known("signal_type", SIGNAL_TYPES)
    if "severity" in has:
        bad["severity"] = known("severity", SEVERITIES)
    for column, most in LONGEST.items():
        if column in has:
            bad[f"{column}_length"] = F.coalesce(F.length(F.col(column).cast("string")) > most, F.lit(False))
    if "struct" in signals.schema["evidence"].dataType.simpleString():
        bad["spans"] = F.coalesce(F.expr(f"not forall(evidence, e -> coalesce({EVIDENCE}, false))"), F.lit(False))
    return signals.withColumn("reasons", F.filter(F.array(*[F.when(c, n) for n, c in bad.items()]), lambda r: r.isNotNull()))
