"""The generic test tables seen as calls, summaries, signals and latencies."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    speaker = F.expr("case role when 'user' then 'customer' when 'assistant' then 'agent' else 'unknown' end")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("call_id"), F.col("turn").alias("seq"), speaker.alias("speaker"), "text",
        (F.col("turn") * 4200).alias("start_ms"), (F.col("turn") * 4200 + 3800).alias("end_ms"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("call_id"), F.lit(0).cast("long").alias("seq"), "text")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("turn_count"))
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    return joined.select(
        F.col("o_orderkey").alias("call_id"),
        F.expr("o_custkey % 50").alias("agent_id"),
        F.col("c_mktsegment").alias("primary_intent"),
        F.expr("case o_orderstatus when 'F' then 'resolved' when 'O' then 'unresolved' else 'follow_up_required' end").alias("resolution"),
        F.expr("cast(o_orderpriority = '1-URGENT' as int)").alias("escalated"),
        F.expr("cast(o_orderkey % 3 as int)").alias("violation_count"),
        F.expr("cast(o_orderkey % 21 - 10 as double) / 10").alias("sentiment_start"),
        F.expr("cast(o_custkey % 21 - 10 as double) / 10").alias("sentiment_end"),
        F.coalesce("turn_count", F.lit(0)).alias("turn_count"),
        F.expr("cast(o_orderdate as timestamp)").alias("ended_at"),
        F.expr("cast(o_orderdate as date)").alias("ended_date"),
    )


SUMMARIES_SQL = """(select o_orderkey as call_id, o_custkey % 50 as agent_id, c_mktsegment as primary_intent,
 case o_orderstatus when 'F' then 'resolved' when 'O' then 'unresolved' else 'follow_up_required' end as resolution,
 cast(o_orderpriority = '1-URGENT' as int) as escalated, cast(o_orderkey % 3 as int) as violation_count,
 cast(o_orderkey % 21 - 10 as double) / 10 as sentiment_start, cast(o_custkey % 21 - 10 as double) / 10 as sentiment_end,
 coalesce(n, 0) as turn_count, cast(o_orderdate as timestamp) as ended_at, cast(o_orderdate as date) as ended_date
 from orders join customer on o_custkey = c_custkey left join (select l_orderkey, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("signal_id"), F.col("user_id").alias("call_id"), F.expr("user_id % 20").alias("agent_id"),
        F.col("event_type").alias("signal_type"), F.concat(F.lit("L"), (k % 3).cast("string")).alias("label"), F.concat(F.lit("P"), (k % 7).cast("string")).alias("policy_id"),
        F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("severity"),
        (F.col("value") / 500).alias("confidence"), F.col("value").alias("duration_ms"), F.col("ts").alias("emitted_at"),
    )


SIGNALS_SQL = """(select event_id as signal_id, user_id as call_id, user_id % 20 as agent_id, event_type as signal_type,
 'L' || cast(cast(json_extract_string(props, '$.k') as int) % 3 as varchar) as label,
 'P' || cast(cast(json_extract_string(props, '$.k') as int) % 7 as varchar) as policy_id,
 case cast(json_extract_string(props, '$.k') as int) % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as severity,
 value / 500 as confidence, value as duration_ms, ts as emitted_at from events)"""

TURNS_SQL = """(select conv_id as call_id, turn as seq, case role when 'user' then 'customer' when 'assistant' then 'agent' else 'unknown' end as speaker,
 text, turn * 4200 as start_ms, turn * 4200 + 3800 as end_ms from conversations)"""

#: Personal data that the invented prose lacks; each document gets one of them.
PLANTED = [
    "my social is 123-45-6789", "born on 4/5/1980", "it is due on 12.11.2024 then", "birthday May 4th, 1980", "on 3 June 2021", "account number 12345-678 please", "acct 9 8 7", "at 12 Old Mill Road, apt 4b",
    "My name is Ana Lee and this is okay", "this is Monday, I'm Bo Ray", "call 555-010-1234", "write to ana.lee@example.org",
    "it is ana dot lee at example dot com then",
]


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = (F.col("call_id") % len(PLANTED) + 1).cast("int")
    return documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, PLANTED)), place)))


PLANTED_SQL = "(select doc_id, text || ' ' || ([" + ", ".join("'" + x.replace("'", "''") + "'" for x in PLANTED) + f"])[doc_id % {len(PLANTED)} + 1] as text from documents)"
