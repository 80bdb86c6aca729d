"""Streaming operators; each has a batch twin or is one on batch input."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from callscope.operators.marts import quantile
from callscope.streaming.state import use_keyed_state


def dedupe_stream(segments: DataFrame, memory: str = "6 hours") -> DataFrame:
    return segments.withWatermark("emitted_at", memory).dropDuplicatesWithinWatermark(["call_id", "seq", "is_final"])


def close_calls(segments: DataFrame, silence: str = "25 seconds", late: str = "1 minute") -> DataFrame:
    """One row a call session, which silence ends."""
    rows = segments.withWatermark("emitted_at", late) if segments.isStreaming else segments
    out = rows.groupBy("call_id", F.session_window("emitted_at", silence).alias("w")).agg(F.count(F.lit(1)).alias("segments"))
    return out.select("call_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "segments")


def signals_hourly(signals: DataFrame, late: str = "1 hour") -> DataFrame:
    rows = signals.withWatermark("emitted_at", late) if signals.isStreaming else signals
    out = rows.groupBy(F.window("emitted_at", "1 hour").alias("w"), "signal_type").agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("w.start").alias("hour"), "signal_type", "events")


def call_activity(segments: DataFrame) -> DataFrame:
    """(call_id, first_seen, last_seen, segments, duplicates, last_seq), batch or stream in update mode.

    Segments of one number and finality are duplicates of each other. A stream keeps a live call's numbers in its state; a batch
    counts them before it groups by call.
    """
    final = F.coalesce("is_final", F.lit(True)) if "is_final" in segments.columns else F.lit(True)
    key = F.col("seq").cast("long") * 2 + final.cast("long")
    first, last, top = F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("last_seq").alias("last_seq")
    rows = segments.select("call_id", F.col("emitted_at").alias("first_seen"), F.col("emitted_at").alias("last_seen"), F.col("seq").alias("last_seq"), key.alias("__key"))
    if segments.isStreaming:
        out = rows.groupBy("call_id").agg(first, last, F.count(F.lit(1)).alias("segments"), F.size(F.collect_set("__key")).alias("__distinct"), top)
    else:
        numbers = rows.groupBy("call_id", "__key").agg(first, last, F.count(F.lit(1)).alias("n"), top)
        out = numbers.groupBy("call_id").agg(first, last, F.sum("n").alias("segments"), F.count("__key").alias("__distinct"), top)
    return out.select("call_id", "first_seen", "last_seen", "segments", (F.col("segments") - F.col("__distinct")).alias("duplicates"), "last_seq")


def slo_alerts(latency: DataFrame, budget_ms: float, width: str = "1 day", exact: bool = True, late: str = "1 hour") -> DataFrame:
    """Windows whose p95 is over the budget, batch or stream (``latency_alerts`` also asks how long)."""
    rows = latency.withWatermark("emitted_at", late) if latency.isStreaming else latency
    out = rows.groupBy(F.window("emitted_at", width).alias("w"), "signal_type").agg(quantile("duration_ms", 0.95, exact).alias("p95"), F.count(F.lit(1)).alias("samples"))
    return out.where(F.col("p95") > budget_ms).select(F.col("w.start").alias("window_start"), "signal_type", F.round("p95", 6).alias("p95_ms"), "samples")


def stage_throughput(latency: DataFrame, width: str = "1 minute", late: str = "1 hour", exact: bool = True) -> DataFrame:
    """(window_start, stage, samples, p50_ms, p95_ms) of (stage, duration_ms, emitted_at), batch or stream."""
    rows = latency.withWatermark("emitted_at", late) if latency.isStreaming else latency
    at = lambda q, n: F.round(quantile("duration_ms", q, exact), 6).alias(n)
    out = rows.groupBy(F.window("emitted_at", width).alias("w"), "stage").agg(F.count(F.lit(1)).alias("samples"), at(0.5, "p50_ms"), at(0.95, "p95_ms"))
    return out.select(F.col("w.start").alias("window_start"), "stage", "samples", "p50_ms", "p95_ms")


def ops_ratios(events: DataFrame, label: str, width: str = "15 minutes") -> DataFrame:
    """(window_start, label, events, share): each label's share of its window's events; null labels count as ``none``."""
    counted = events.groupBy(F.window("emitted_at", width).alias("w"), F.coalesce(F.col(label).cast("string"), F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("events"))
    whole = counted.groupBy("w").agg(F.sum("events").alias("all"))  # both counts come from the same small table
    return counted.join(whole, "w").select(F.col("w.start").alias("window_start"), "label", "events", F.round(F.col("events") / F.col("all"), 6).alias("share"))


#: Alert, what it measures, of what, the limit, the minutes that are looked back on, and how many minutes it must hold.
#: A count or share of the range's sums must pass the limit. ``lag`` is a level: its newest value in the range counts.
ALERTS = (
    ("final_segments_shed", "dropped_final", None, 0.0, 5, 0),
    ("rows_dropped", "row_dropped", None, 0.0, 10, 0),
    ("summaries_failing", "summary_failed", "summary", 0.1, 15, 10),
    ("hold_churn", "hold", "final", 0.5, 5, 10),
    ("consumer_lag", "lag", None, 5000.0, 5, 5),
)
#: Nothing is redacted while more segments a second than this are emitted, over so many minutes, for so many minutes.
REDACTION_ALERT = ("redaction_collapsed", "redaction", "segment", 0.1, 15, 15)
#: The latency alert's limit in ms, its range and how long it must hold, in minutes.
LATENCY_ALERT = ("signal_latency", 2000.0, 5, 3)
#: A share's divisor is at least so much (else nothing passes where nothing is counted).
LEAST_WHOLE = {"summaries_failing": 1, "hold_churn": 0}
FIRED = "alert string, since timestamp, fired_at timestamp, value double"


def _evaluations(events: DataFrame, step: str, late: str) -> DataFrame:
    """(alert, at, value, breached, holds) at every ``step``: an event counts in each range that reaches back to it."""
    rows = events.withWatermark("emitted_at", late) if events.isStreaming else events
    total = lambda name: F.sum(F.when(F.col("event") == name, F.col("n")).otherwise(0)).cast("double")
    ranges: dict[int, list[Column]] = {}
    for alert, part, whole, limit, minutes, holds in ALERTS:
        value = F.max_by(F.when(F.col("event") == part, F.col("n")), F.when(F.col("event") == part, F.col("emitted_at"))).cast("double") if part == "lag" else total(part)
        if whole:
            # compared without a division: part > limit * whole
            base = F.greatest(total(whole), F.lit(float(LEAST_WHOLE[alert])))
            breached, value = value > limit * base, F.when(base > 0, value / F.when(base > 0, base))
        else:
            breached = value > limit
        ranges.setdefault(minutes, []).append(_evaluated(alert, value, breached, holds))
    alert, part, whole, least, minutes, holds = REDACTION_ALERT
    flow = total(whole) / (minutes * 60)
    ranges.setdefault(minutes, []).append(_evaluated(alert, flow, (total(part) == 0) & (flow > least), holds))
    parts = []
    for minutes, own in ranges.items():
        slid = rows.groupBy(F.window("emitted_at", f"{minutes} minutes", step).alias("w")).agg(*[c.alias(f"a{k}") for k, c in enumerate(own)])
        each = slid.select(F.col("w.end").alias("at"), F.explode(F.array(*[f"a{k}" for k in range(len(own))])).alias("a"))
        parts.append(each.select("a.alert", "at", "a.value", "a.breached", "a.holds"))
    return reduce(DataFrame.unionByName, parts)


def _evaluated(alert: str, value: Column, breached: Column, holds: int) -> Column:
    return F.struct(F.lit(alert).alias("alert"), value.alias("value"), F.coalesce(breached, F.lit(False)).alias("breached"), F.lit(holds).alias("holds"))


def fired_alerts(evaluations: DataFrame, step: str) -> DataFrame:
    """``FIRED`` rows of (alert, at, value, breached, holds): each run of breached evaluations that lasts ``holds`` minutes fires once.

    A run is unbroken: an evaluation that isn't breached, or is missing, ends it. ``since`` is its first evaluation, ``fired_at`` the
    first that is ``holds`` minutes later, ``value`` the value then.
    """
    # gaps and islands: breached times less their number times the step are equal within a run
    nth = F.row_number().over(Window.partitionBy("alert").orderBy("at"))
    runs = evaluations.where("breached").withColumn("run", F.col("at") - F.expr(f"interval {step}") * nth)
    first = runs.withColumn("since", F.min("at").over(Window.partitionBy("alert", "run")))
    held = first.where(F.col("at") >= F.col("since") + F.make_dt_interval(mins=F.col("holds")))
    fired = held.groupBy("alert", "run", "since").agg(F.min("at").alias("fired_at"), F.min_by("value", "at").alias("value"))
    return fired.select("alert", "since", "fired_at", F.round("value", 6).alias("value"))


class AlertRuns(StatefulProcessor):
    """The open run of each alert, kept from batch to batch: its start, its last evaluation, and whether it has fired."""

    def __init__(self, step_ms: int):
        self.step_ms = step_ms

    def init(self, handle) -> None:
        self.run = handle.getValueState("run", "since long, last long, fired boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        since, last, fired = self.run.get() if self.run.exists() else (-1, -1, False)
        out = []
        for e in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            at = int(e.at.value // 1_000_000) if hasattr(e.at, "value") else int(e.at.timestamp() * 1000)
            if not e.breached:
                since = -1
            elif since < 0 or at - int(last) != self.step_ms:
                since, fired = at, False
            if e.breached and not fired and at - since >= e.holds * 60_000:
                out.append((key[0], pd.Timestamp(since, unit="ms"), pd.Timestamp(at, unit="ms"), round(float(e.value), 6)))
                fired = True
            last = at
        self.run.update((int(since), int(last), bool(fired)))
        yield pd.DataFrame(out, columns=["alert", "since", "fired_at", "value"])

    def close(self) -> None:
        pass


def ops_alerts(events: DataFrame, step: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """``FIRED`` rows of counters (event, n, emitted_at), batch or stream: when each alert's condition had held for its time.

    Conditions are evaluated at every ``step`` over sliding ranges (``step`` must divide 5 minutes); an evaluation whose range holds no
    event at all counts as quiet. A stream closes an evaluation as the watermark passes it, so it fires ``late`` after the fact.
    """
    found = _evaluations(events, step, late)
    return _fired(found, step)


def _fired(found: DataFrame, step: str) -> DataFrame:
    if not found.isStreaming:
        return fired_alerts(found, step)
    use_keyed_state(found.sparkSession)
    step_ms = int(pd.Timedelta(step).total_seconds() * 1000)
    return found.groupBy("alert").transformWithStateInPandas(AlertRuns(step_ms), FIRED, "append", "None")


def latency_alerts(latency: DataFrame, step: str = "1 minute", late: str = "5 minutes", exact: bool = True) -> DataFrame:
    """``FIRED`` rows of (duration_ms, emitted_at): when the 95th percentile of a sliding range had been over the budget for its time.

    ``exact`` gathers the durations of each range; false takes a sketch of bounded size.
    """
    alert, budget, minutes, holds = LATENCY_ALERT
    rows = latency.withWatermark("emitted_at", late) if latency.isStreaming else latency
    slid = rows.groupBy(F.window("emitted_at", f"{minutes} minutes", step).alias("w")).agg(quantile("duration_ms", 0.95, exact).alias("value"))
    value = F.col("value").cast("double")
    found = slid.select(F.lit(alert).alias("alert"), F.col("w.end").alias("at"), value.alias("value"), (value > budget).alias("breached"), F.lit(holds).alias("holds"))
    return _fired(found, step)


#: Ratio, its events and what they are divided by.
RATIOS = {
    "rejected": ("rejected", "segment"), "duplicate": ("duplicate", "segment"), "shed": ("dropped_final", "segment"), "redactions": ("redaction", "final"),
    "holds": ("hold", "final"), "claims_dropped": ("claim_dropped", "claim"), "tokens_per_summary": ("tokens", "summary"),
}


def ops_panel(events: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(window_start, ratio, value) of (event, n, emitted_at): each of ``RATIOS`` over its window, divided by 1 at least."""
    rows = events.withWatermark("emitted_at", late) if events.isStreaming else events
    names = sorted({x for pair in RATIOS.values() for x in pair})
    sums = rows.groupBy(F.window("emitted_at", width).alias("w")).agg(*[F.sum(F.when(F.col("event") == x, F.col("n")).otherwise(0)).alias(x) for x in names])
    each = F.array(*[F.struct(F.lit(r).alias("ratio"), F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6).alias("value")) for r, (a, b) in RATIOS.items()])
    return sums.select(F.col("w.start").alias("window_start"), F.explode(each).alias("x")).select("window_start", "x.ratio", "x.value")


#: Breakdown, the event that it splits, by which column, and the event that it is divided by.
BREAKDOWNS = {
    "rejects_by_reason": ("rejected", "reason", "segment"), "redactions_by_type": ("redaction", "type", "final"), "redactions_by_detector": ("redaction", "detector", "final"),
    "claims_by_outcome": ("claim", "outcome", "claim"), "tools_by_outcome": ("tool", "outcome", "tool"),
}


def ops_breakdown(events: DataFrame, width: str = "15 minutes") -> DataFrame:
    """(window_start, breakdown, label, n, share) of counters (event, n, emitted_at, and the columns that ``BREAKDOWNS`` split by, if there).

    Labels that are missing are ``none``; a share's divisor is 1 at least.
    """
    split = {name: x for name, x in BREAKDOWNS.items() if x[1] in events.columns}
    each = F.array(*[
        F.struct(F.lit(name).alias("breakdown"), F.coalesce(F.col(by).cast("string"), F.lit("none")).alias("label"), F.when(F.col("event") == part, F.col("n")).alias("part"), F.when(F.col("event") == whole, F.col("n")).alias("whole"))
        for name, (part, by, whole) in split.items()
    ])
    kept = F.filter(each, lambda x: x["part"].isNotNull() | x["whole"].isNotNull())
    rows = events.select("emitted_at", F.explode_outer(kept).alias("x")).where("x is not null").select(F.window("emitted_at", width).alias("w"), "x.*")
    counted = rows.groupBy("w", "breakdown", "label").agg(F.sum("part").alias("n"), F.coalesce(F.sum("whole"), F.lit(0)).alias("whole"))
    whole = counted.groupBy("w", "breakdown").agg(F.sum("whole").alias("all"))
    out = counted.where("n is not null").join(whole, ["w", "breakdown"])
    return out.select(F.col("w.start").alias("window_start"), "breakdown", "label", "n", F.round(F.col("n") / F.greatest(F.col("all"), F.lit(1)), 6).alias("share"))


def late_rows(segments: DataFrame, late: str = "1 minute") -> DataFrame:
    """``segments`` with ``is_late``: emitted more than ``late`` before the newest row that came before it.

    The order of arrival is that of the column ``arrived``; a stream counts what its watermark drops in its progress reports.
    """
    seen = F.max("emitted_at").over(Window.partitionBy("call_id").orderBy("arrived").rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("is_late", F.coalesce(F.col("emitted_at") < seen - F.expr(f"interval {late}"), F.lit(False)))
