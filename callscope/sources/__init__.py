"""Readers and writers of calls, segments and fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators import facts
from callscope.operators.contracts import is_compatible
from callscope.sources import ledger

SEGMENT = (
    "schema_version string, call_id string, seq int, speaker string, text string, is_final boolean, start_ms int, end_ms int, emitted_at string, "
    "redactions array<struct<type:string,placeholder:string,start:int,end:int,detector:string,confidence:double>>, asr_confidence double, agent_id string, traceparent string"
)


#: Reasons for which a line is no segment, in the order in which they are looked for.
REJECTED = ("json", "call_id", "version")


def _parsed_segments(raw: DataFrame) -> DataFrame:
    """``raw`` with ``s``, each ``value`` as a segment, and ``reason``: why it is none (null if it is one). A missing version is readable."""
    s = F.from_json("value", SEGMENT + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    whole = F.coalesce(F.col("s").isNotNull() & F.col("s._corrupt_record").isNull(), F.lit(False))
    why = F.when(~whole, "json").when(F.coalesce("s.call_id", F.lit("")) == "", "call_id").when(~is_compatible("s.schema_version"), "version")
    return raw.withColumn("s", s).withColumn("reason", why)


def _segments_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").select("s.*").drop("_corrupt_record").withColumn("emitted_at", F.try_to_timestamp("emitted_at"))


def read_segments(spark: SparkSession, path: str, streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments, rejects) of JSON lines; a reject is the line and its reason, one of ``REJECTED``."""
    parsed = _parsed_segments((spark.readStream if streaming else spark.read).text(path))
    return _segments_of(parsed), parsed.where("reason is not null").select("value", "reason")


def observed_segments(lines: DataFrame, name: str = "segments") -> DataFrame:
    """The segments of JSON lines in ``value``; lines and rejects by reason are counted in the same pass, as metrics of that name.

    A stream reports them with its progress (``streaming.metrics.StreamCounts`` adds them up).
    """
    parsed = _parsed_segments(lines.select("value"))
    counts = [F.count_if(F.col("reason") == r).alias(f"rejected_{r}") for r in REJECTED]
    return _segments_of(parsed.observe(name, F.count(F.lit(1)).alias("lines"), *counts))


def read_keyed_segments(rows: DataFrame, name: str = "segments") -> DataFrame:
    """``observed_segments`` of a keyed topic, batch or stream: (key, value) as text or bytes.

    A segment whose call isn't that of its key is rejected as ``key``; rows without a key keep the call that they name.
    """
    parsed = _parsed_segments(rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")))
    foreign = F.coalesce(F.col("reason").isNull() & (F.col("key") != F.col("s.call_id")), F.lit(False))
    parsed = parsed.withColumn("reason", F.when(foreign, "key").otherwise(F.col("reason")))
    counts = [F.count_if(F.col("reason") == r).alias(f"rejected_{r}") for r in (*REJECTED, "key")]
    return _segments_of(parsed.observe(name, F.count(F.lit(1)).alias("lines"), *counts))


def reject_reasons(rejects: DataFrame) -> DataFrame:
    """(reason, lines) of rejected lines."""
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def to_kafka_rows(df: DataFrame, key: str = "call_id") -> DataFrame:
    """(key, value) for a keyed topic: the row as JSON under its call."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def stream_to_fact(df: DataFrame, table: str, ts: str, checkpoint: str, grain: str = "month", every: str = "2 seconds"):
    """Start the append of a stream to a fact table with a commit ledger (``ledger.read_fact`` reads it); a batch counts once."""

    def add(batch: DataFrame, number: int) -> None:
        ledger.append(batch, table, ts, ledger.stream_id(batch), number, grain)

    return df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def write_segments_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_fact(df: DataFrame, path: str, ts: str, grain: str = "month") -> None:
    """Append, partitioned by the month or day of ``ts``."""
    form = {"month": "yyyyMM", "day": "yyyyMMdd"}[grain]
    df.withColumn(grain, F.date_format(ts, form)).write.mode("append").partitionBy(grain).parquet(path)


CALL = (
    "call_id string, category string, agent_id string, turns array<struct<idx:int,speaker:string,text:string,pii:array<struct<type:string,start:int,end:int,value:string,surface_form:string,is_partial:boolean>>>>, "
    "labels struct<primary_intent:string,resolution:string,sentiment_start:double,sentiment_end:double,escalation_risk:string,escalated:boolean,secondary_intents:array<string>,"
    "required_disclosures:array<string>,disclosures_given:array<string>,compliance_violations:array<string>,action_items:array<string>>"
)


def read_calls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns, spans, labels) of labelled calls, one JSON document a file; files that are no call give no rows."""
    calls = spark.read.schema(CALL).json(path, multiLine=True).where("call_id is not null")
    rows = calls.select("call_id", "category", F.explode("turns").alias("t"))
    turns = rows.select("call_id", F.col("t.idx").cast("long").alias("seq"), "t.speaker", "t.text")
    spans = rows.select("call_id", "category", F.col("t.idx").cast("long").alias("seq"), F.explode("t.pii").alias("p")).select("call_id", "category", "seq", "p.*")
    return turns, spans, calls.select("call_id", "category", "labels.*")


def load_policies(spark: SparkSession, rows: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(policies, phrases) of a catalog; ``intents`` are those that ``applies_when`` lists as ``intent in [a, b]``."""
    schema = "id string, title string, kind string, severity string, window string, applies_when string, summary string, satisfied_by_phrases array<string>, prohibited_phrases array<string>"
    names = [c.split()[0] for c in schema.split(", ")]
    raw = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).withColumnRenamed("id", "policy_id")
    listed = F.regexp_extract(F.coalesce("applies_when", F.lit("")), r"(?i)\bintent\s+in\s*\[([^\]]*)\]", 1)
    intents = F.filter(F.transform(F.split(listed, ","), lambda x: F.regexp_replace(x, r"""^[\s'"]+|[\s'"]+$""", "")), lambda x: x != "")
    policies = raw.withColumn("intents", intents).withColumn("severity", F.coalesce("severity", F.lit("medium")))
    use = lambda column, name: policies.select("policy_id", F.lit(name).alias("use"), F.explode(column).alias("phrase"))
    return policies, use("prohibited_phrases", "prohibited").unionByName(use("satisfied_by_phrases", "satisfies"))


SPAN = "struct<seq:int,start_ms:int,end_ms:int,speaker:string,quote:string>"
INSIGHT = (
    "schema_version string, kind string, call_id string, agent_id string, emitted_at string, traceparent string, "
    "signals array<struct<signal_id:string,call_id:string,type:string,label:string,severity:string,confidence:double,rationale:string,"
    f"evidence:array<{SPAN}>,policy_id:string,window_start_ms:int,window_end_ms:int,emitted_at:string,agent_id:string,"
    "latency:struct<asr_ms:double,redact_ms:double,ingest_ms:double,queue_ms:double,analyze_ms:double,llm_ms:double,segment_to_signal_ms:double>,"
    "model_name:string,prompt_version:string,traceparent:string>>, "
    "summary struct<call_id:string,summary:string,resolution:string,primary_intent:string,secondary_intents:array<string>,"
    f"action_items:array<struct<description:string,owner:string,due:string,evidence:array<{SPAN}>>>,customer_sentiment_start:double,customer_sentiment_end:double,"
    "escalated:boolean,compliance_violations:array<string>,disclosures_given:array<string>,model_name:string,prompt_version:string,generated_at:string>"
)


def read_insights(envelopes: DataFrame) -> DataFrame:
    """Envelopes of JSON in ``value`` as columns, with ``reason``: why one is left out (null if it isn't).

    ``json``: no JSON object; ``version``: of another major version (a missing one is readable); ``kind``: neither ``live`` nor
    ``post_call``; ``call_id``: none; ``payload``: a live one without signals, or a post-call one without a summary.
    """
    e = envelopes.select("value", F.from_json("value", INSIGHT + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"))
    whole = F.coalesce(F.col("e").isNotNull() & F.col("e._corrupt_record").isNull(), F.lit(False))
    empty = ((F.col("e.kind") == "live") & ~F.coalesce(F.size("e.signals") > 0, F.lit(False))) | ((F.col("e.kind") == "post_call") & F.col("e.summary").isNull())
    reason = (
        F.when(~whole, "json").when(~is_compatible("e.schema_version"), "version").when(~F.coalesce(F.col("e.kind").isin("live", "post_call"), F.lit(False)), "kind")
        .when(F.coalesce("e.call_id", F.lit("")) == "", "call_id").when(empty, "payload")
    )
    return e.select("value", "e.*", reason.alias("reason")).drop("_corrupt_record")


def route_insights(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals, summaries) of JSON envelopes in ``value``: kind ``live`` carries signals, ``post_call`` a summary; others give no rows.

    Both have ``envelope_agent``; a time that can't be read is that of reading, so the row isn't lost. A signal's call and trace are
    its own. A summary has the time and trace of its envelope.
    """
    e = read_insights(envelopes).where("reason is null")
    lenient = lambda c: F.coalesce(F.try_to_timestamp(c), F.current_timestamp())
    live = e.where("kind = 'live'").select(F.col("agent_id").alias("envelope_agent"), F.explode("signals").alias("s")).select("envelope_agent", "s.*")
    ended = e.where("kind = 'post_call'").select(F.col("agent_id").alias("envelope_agent"), "emitted_at", "traceparent", "summary.*")
    return live.withColumnRenamed("type", "signal_type").withColumn("emitted_at", lenient("emitted_at")), ended.withColumn("emitted_at", lenient("emitted_at"))


def insight_rows(envelopes: DataFrame, call_facts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows of the fact tables ``signals``, ``latencies`` and ``summaries`` that JSON envelopes in ``value`` carry."""
    live, ended = route_insights(envelopes)
    agent = F.when(F.col("envelope_agent") != "", F.col("envelope_agent"))
    ended = ended.withColumn("agent_id", F.col("envelope_agent"))
    return {
        "signals": facts.to_signal_rows(live, agent),
        "latencies": facts.to_latency_rows(live, agent),
        "summaries": facts.to_summary_rows(ended, call_facts, agent),
    }


#: The time column of each fact table, and what its rows are partitioned by.
FACT_TABLES = {"signals": ("emitted_at", "month"), "latencies": ("emitted_at", "day"), "summaries": ("ended_at", "month")}


def sink_insights(envelopes: DataFrame, root: str, checkpoint: str, every: str = "2 seconds", once: bool = False):
    """Start the fan-out of a stream of JSON envelopes into the fact tables under ``root``, each with its commit ledger.

    A batch is parsed once a table and committed table by table; after a failure the tables that have it skip it.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, rows in insight_rows(batch).items():
            ts, grain = FACT_TABLES[name]
            ledger.append(rows, f"{root}/{name}", ts, ledger.stream_id(batch), number, grain)
        batch.unpersist()

    writer = envelopes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
