"""Rollups and dashboard queries over signals, summaries and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(df: DataFrame, ts: str, days: int | None, as_of) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; all rows without ``days``."""
    return df if days is None else df.where(F.col(ts) >= F.date_sub(F.to_date(F.lit(as_of)), days))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(100.0 * part, whole), digits)


def mean(value: Column, digits: int = 3) -> Column:
    return F.round(F.avg(value), digits) + 0.0  # no negative zero


def quantile(column: str, q: float, exact: bool = True) -> Column:
    """A quantile aggregate: exact (one key's distinct values meet in one task), or from a sketch of bounded size."""
    if exact:
        return F.percentile(column, F.lit(q))
    return F.expr(f"kll_sketch_get_quantile_double(kll_sketch_agg_double(cast({column} as double)), {q}D)")


def intent_distribution(summaries: DataFrame, days: int | None = None, as_of=None) -> DataFrame:
    calls = F.count(F.lit(1))
    out = recent(summaries, "ended_at", days, as_of).groupBy("primary_intent").agg(
        calls.alias("calls"), F.count_if(F.col("escalated") == 1).alias("escalated_calls"),
        percent(F.count_if(F.col("escalated") == 1), calls).alias("escalation_rate_pct"),
        percent(F.count_if(F.col("resolution") == "resolved"), calls).alias("resolved_pct"),
        F.round(F.avg("turn_count"), 1).alias("avg_turns"),
    )
    return out.withColumn("share_pct", percent(F.col("calls"), F.sum("calls").over(Window.partitionBy())))  # one row an intent


def sentiment_by_hour(summaries: DataFrame, grain: str = "hour", days: int | None = None, as_of=None) -> DataFrame:
    return recent(summaries, "ended_at", days, as_of).groupBy(F.date_trunc(grain, "ended_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("calls"), mean(F.col("sentiment_start")).alias("avg_start"), mean(F.col("sentiment_end")).alias("avg_end"),
        mean(F.col("sentiment_end") - F.col("sentiment_start")).alias("avg_delta"), F.count_if(F.col("sentiment_end") < -0.4).alias("ended_unhappy"),
    )


def violations_by_policy(signals: DataFrame, kind: str = "compliance_violation", days: int | None = 7, as_of=None) -> DataFrame:
    return recent(signals.where(F.col("signal_type") == kind), "emitted_at", days, as_of).groupBy("policy_id").agg(F.count(F.lit(1)).alias("events"))


def violation_rate(signals: DataFrame, summaries: DataFrame, kind: str = "compliance_violation", days: int | None = 30, as_of=None, exact: bool = True) -> DataFrame:
    """Per policy: the share of all calls with a violation. The total is one row."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    by = recent(signals.where((F.col("signal_type") == kind) & (F.col("policy_id") != "")), "emitted_at", days, as_of).groupBy("policy_id").agg(
        distinct("call_id").alias("calls_with_violation"), F.count_if(F.col("severity").isin("critical", "high")).alias("severe_events"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"),
    )
    total = recent(summaries, "ended_at", days, as_of).agg(distinct("call_id").alias("total_calls"))
    return by.crossJoin(F.broadcast(total)).withColumn("violation_rate_pct", percent(F.col("calls_with_violation"), F.col("total_calls")))


def policy_violation_rates(signals: DataFrame, kind: str = "compliance_violation", exact: bool = True) -> DataFrame:
    """Calls, events and severity by policy; without ``exact`` the calls are estimated from a sketch of bounded size."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return signals.where(F.col("signal_type") == kind).groupBy("policy_id").agg(
        distinct("call_id").alias("calls"), F.count(F.lit(1)).alias("events"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("severe_events"),
    )


def latency_percentiles(latency: DataFrame, budget_ms: float = 2000, stage: str = "stage", days: int | None = None, as_of=None, exact: bool = True) -> DataFrame:
    q = lambda p: F.round(quantile("duration_ms", p, exact), 1)
    n = F.count(F.lit(1))
    return recent(latency, "emitted_at", days, as_of).groupBy(F.col(stage).alias("stage")).agg(
        n.alias("samples"), q(0.5).alias("p50_ms"), q(0.95).alias("p95_ms"), q(0.99).alias("p99_ms"), F.round(F.max("duration_ms"), 1).alias("max_ms"),
        percent(F.count_if(F.col("duration_ms") > budget_ms), n, 3).alias("pct_over_budget"),
    )


def overview(summaries: DataFrame) -> DataFrame:
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return summaries.agg(
        F.count(F.lit(1)).alias("calls"), F.sum("escalated").cast("long").alias("escalations"), F.sum("violation_count").cast("long").alias("violations"),
        percent(F.sum("escalated"), n).alias("escalation_pct"), F.round(F.sum("violation_count") / n, 3).alias("violations_per_call"),
        mean(F.col("sentiment_end") - F.col("sentiment_start")).alias("avg_delta"),
    )


SIGNAL_KEYS = ("agent_id", "signal_type", "label", "severity", "policy_id")


def rollup_signals_hourly(signals: DataFrame, grain: str = "hour", null_as_zero: bool = False) -> DataFrame:
    """Mergeable states: sums, counts and sketches for distinct calls and latency quantiles.

    A missing latency is left out; with ``null_as_zero`` it counts as 0, as a rollup of stored rows without nulls would have it.
    """
    latency = "coalesce(duration_ms, 0D)" if null_as_zero else "duration_ms"
    return signals.groupBy(F.date_trunc(grain, "emitted_at").alias("hour"), *SIGNAL_KEYS).agg(
        F.count(F.lit(1)).alias("events"), F.sum("confidence").alias("confidence_sum"), F.hll_sketch_agg("call_id").alias("calls_hll"),
        F.expr(f"kll_sketch_agg_double(cast({latency} as double))").alias("latency_kll"),
    )


def merge_rollup(rollup: DataFrame, by: list[str], grain: str | None = None) -> DataFrame:
    """The same states on coarser keys: fewer of ``SIGNAL_KEYS``, and ``hour`` cut to ``grain`` if one is given."""
    keys = [F.date_trunc(grain, "hour").alias("hour"), *by] if grain else by
    return rollup.groupBy(*keys).agg(
        F.sum("events").alias("events"), F.sum("confidence_sum").alias("confidence_sum"), F.hll_union_agg("calls_hll").alias("calls_hll"),
        F.expr("kll_merge_agg_double(latency_kll)").alias("latency_kll"),
    )


def exact_rollup(signals: DataFrame, by: list[str], grain: str = "day") -> DataFrame:
    """What merged states estimate, worked out from the signals themselves."""
    return signals.groupBy(F.date_trunc(grain, "emitted_at").alias("hour"), *by).agg(
        F.count(F.lit(1)).alias("events"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.count_distinct("call_id").alias("calls"),
    )


def merge_signals(rollup: DataFrame, by: list[str]) -> DataFrame:
    return rollup.groupBy(*by).agg(
        F.sum("events").alias("events"), F.round(F.sum("confidence_sum") / F.sum("events"), 4).alias("avg_confidence"),
        F.hll_sketch_estimate(F.hll_union_agg("calls_hll")).alias("calls"),
        F.expr("kll_sketch_get_quantile_double(kll_merge_agg_double(latency_kll), 0.95)").alias("p95_ms"),
    )


def rollup_agent_daily(summaries: DataFrame, version: str | None = None) -> DataFrame:
    """Additive sums by day and agent; with ``version`` only the current version of each call counts, so later versions replace earlier ones."""
    rows = summaries if version is None else current_versions(summaries, version)
    return rows.groupBy(F.col("ended_date").alias("day"), "agent_id").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("escalated").cast("long").alias("escalations"), F.sum("violation_count").cast("long").alias("violations"),
        F.count_if(F.col("resolution") == "resolved").alias("resolved"), F.sum(F.col("sentiment_end") - F.col("sentiment_start")).alias("delta_sum"),
        F.sum("turn_count").cast("long").alias("turns"),
    )


def current_versions(summaries: DataFrame, version: str) -> DataFrame:
    """``current_summaries`` by an aggregate that combines before it shuffles: a call with very many versions isn't one task's sort."""
    row = F.struct(*[F.col(f"`{c}`") for c in summaries.columns])
    best = summaries.groupBy("call_id").agg(F.max_by(row, F.struct(F.col(version), F.xxhash64(*summaries.columns))).alias("__row"))
    return best.select("__row.*")


def rollup_call_sketches(summaries: DataFrame, batch: str, by: list[str] | None = None) -> DataFrame:
    """(batch, ended_date, by, calls): theta sketches of the calls that each appended batch of summaries holds."""
    return summaries.groupBy(F.col(batch).alias("batch"), "ended_date", *(by or ["agent_id"])).agg(F.theta_sketch_agg(F.col("call_id").cast("string")).alias("calls"))


def merge_call_sketches(rollup: DataFrame, by: list[str]) -> DataFrame:
    """(by, calls): estimated distinct calls of sketches by batch, where a later batch's version of a call replaces the earlier ones.

    A batch's sketch loses the calls of all later batches (theta difference) before the batches are united, so a call counts under
    the keys of its last version only. Batches are numbers; what they hold is never read again.
    """
    whole = rollup.groupBy("batch").agg(F.theta_union_agg("calls").alias("all"))  # a row a batch
    numbers = rollup.select(F.col("batch").alias("own")).distinct()
    later = numbers.join(F.broadcast(whole), F.col("batch") > F.col("own")).groupBy("own").agg(F.theta_union_agg("all").alias("later"))
    kept = rollup.join(later, F.col("batch") == F.col("own"), "left")
    calls = F.when(F.col("later").isNull(), F.col("calls")).otherwise(F.theta_difference("calls", F.coalesce("later", "calls")))
    return kept.withColumn("calls", calls).groupBy(*by).agg(F.theta_sketch_estimate(F.theta_union_agg("calls")).alias("calls"))


def agent_league(rollup: DataFrame, least_calls: int = 3) -> DataFrame:
    sums = rollup.groupBy("agent_id").agg(*[F.sum(c).alias(c) for c in ("calls", "escalations", "violations", "resolved", "delta_sum", "turns")])
    return sums.where(F.col("calls") >= least_calls).select(
        "agent_id", F.col("calls").alias("call_count"), F.col("escalations").alias("escalation_count"), percent(F.col("escalations"), F.col("calls")).alias("escalation_rate_pct"),
        F.col("violations").alias("violation_count"), percent(F.col("resolved"), F.col("calls")).alias("resolved_pct"),
        (F.round(F.col("delta_sum") / F.col("calls"), 3) + 0.0).alias("sentiment_delta"), F.round(F.col("turns") / F.col("calls"), 1).alias("turns_per_call"),
    )


def current_summaries(summaries: DataFrame, version: str = "generated_at") -> DataFrame:
    """The latest version of each call's summary; of equal versions the one with the larger row hash, so that no choice is arbitrary."""
    w = Window.partitionBy("call_id").orderBy(F.col(version).desc(), F.xxhash64(*summaries.columns).desc())
    return summaries.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def recent_calls(summaries: DataFrame, n: int = 50) -> DataFrame:
    return summaries.orderBy(F.col("ended_at").desc(), "call_id").limit(n)


def rank_signals(signals: DataFrame, by: str = "call_id") -> DataFrame:
    rank = F.expr("case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end")
    w = Window.partitionBy(by).orderBy(rank, F.col("confidence").desc(), "signal_id")
    return signals.withColumn("rank", F.row_number().over(w))


def active_calls(segments: DataFrame) -> DataFrame:
    return segments.groupBy("call_id").agg(F.max("emitted_at").alias("last_seen"))


def replay_tail(events: DataFrame, n: int = 400) -> DataFrame:
    return events.orderBy(F.col("emitted_at").desc(), F.col("signal_id").desc()).limit(n)


def event_feed(segments: DataFrame, signals: DataFrame, summaries: DataFrame) -> DataFrame:
    """(kind, call_id, id, emitted_at) of all three tables, for ``replay_tail`` by ``signal_id`` as id."""
    row = lambda df, kind, id_, at: df.select(F.lit(kind).alias("kind"), F.col("call_id").cast("string").alias("call_id"), F.col(id_).cast("string").alias("signal_id"), F.col(at).cast("timestamp").alias("emitted_at"))
    return row(segments, "segment", "seq", "emitted_at").unionByName(row(signals, "signal", "signal_id", "emitted_at")).unionByName(row(summaries, "summary", "call_id", "ended_at"))


def call_detail(summaries: DataFrame, signals: DataFrame) -> DataFrame:
    """The current summary of each call with its signals in time order."""
    own = signals.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("emitted_at", "signal_id", "signal_type"))).alias("signals"))
    return summaries.join(own, "call_id", "left")


def apply_retention(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    return recent(df, ts, days, as_of)
