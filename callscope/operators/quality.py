"""Quality measures over predictions, labels and latencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators.marts import quantile
from callscope.operators.order import order_statistics


def prf(counts: DataFrame, beta: float = 2.0) -> DataFrame:
    """Adds precision, recall and F to rows with tp, fp, fn; 0 where nothing divides."""
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    f = F.coalesce(F.try_divide((1 + beta * beta) * F.col("precision") * F.col("recall"), beta * beta * F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f", F.round(f, 6)).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


def binary_prf(pairs: DataFrame, predicted: str, gold: str, by: list[str] | None = None, beta: float = 1.0) -> DataFrame:
    p, g = F.col(predicted).cast("boolean"), F.col(gold).cast("boolean")
    return prf(pairs.groupBy(*(by or [])).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn")), beta)


def confusions(pairs: DataFrame, predicted: str, gold: str, top: int = 6) -> DataFrame:
    """The ``top`` most frequent wrong predictions of each label."""
    c = pairs.where(F.col(predicted) != F.col(gold)).groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("gold").orderBy(F.col("n").desc(), "predicted")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def accuracy(pairs: DataFrame, predicted: str, gold: str) -> DataFrame:
    right = F.col(predicted) == F.col(gold)
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))


def nearest_rank(df: DataFrame, value: str, by: str, q: float) -> DataFrame:
    """(by, value): the value at place round(q n + 0.5) - 1, halves to even, clamped; selected by counts, not by a sort of a key's values."""
    n = F.count(F.lit(1)).cast("double")
    place = F.least(F.greatest(F.bround(q * n + 0.5), F.lit(1.0)), n)
    ranks = df.where(F.col(value).isNotNull()).groupBy(by).agg((place - 1).cast("long").alias("rank"))
    return order_statistics(df, [by], value, ranks).select(by, F.col("value").cast(df.schema[value].dataType).alias("value"))


#: Metric, whether higher is better, whether a loss fails the run, and the change that is noise.
METRICS = [
    ("leak_rate", False, True, 0.0), ("redaction_recall", True, True, 0.0), ("redaction_precision", True, False, 0.005),
    ("redaction_f2", True, False, 0.0), ("type_accuracy", True, False, 0.005), ("citation_validity", True, True, 0.0),
    ("evidence_rate", True, True, 0.0), ("schema_valid", True, False, 0.0), ("intent_accuracy", True, False, 0.005),
    ("resolution_accuracy", True, False, 0.005), ("escalation_band", True, False, 0.005), ("escalated_f1", True, False, 0.0),
    ("violation_recall", True, False, 0.0), ("violation_precision", True, False, 0.005), ("disclosure_f1", True, False, 0.0),
    ("sentiment_direction", True, False, 0.005), ("action_item_recall", True, False, 0.01), ("live_p95_ms", False, False, 1.0),
]


def compare_runs(before: DataFrame, after: DataFrame, metrics: list[tuple[str, bool, bool, float]] | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows (by, metric, value) of two runs: before, after, delta, ``change`` and whether it fails a gate.

    ``change`` is ``same`` within the metric's tolerance, else ``better`` or ``worse`` in its direction. Metrics that one run
    lacks, and those not listed, are left out.
    """
    rows = metrics if metrics is not None else METRICS
    known = before.sparkSession.createDataFrame(rows, "metric string, higher boolean, gate boolean, tolerance double")
    keys = [*(by or []), "metric"]
    j = before.select(*keys, F.col("value").alias("before")).join(after.select(*keys, F.col("value").alias("after")), keys).join(F.broadcast(known), "metric")
    delta = F.col("after") - F.col("before")
    change = F.when(F.abs(delta) <= F.col("tolerance"), "same").when((delta > 0) == F.col("higher"), "better").otherwise("worse")
    out = j.where("before is not null and after is not null").withColumn("change", change)
    return out.select(*keys, "before", "after", F.round(delta, 6).alias("delta"), "change", (F.col("gate") & (F.col("change") == "worse")).alias("fails"))


def run_verdict(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, metrics, better, worse, passed): a run passes if no gate fails."""
    is_ = lambda c: F.count_if(F.col("change") == c).alias(c)
    return compared.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("metrics"), is_("better"), is_("worse"), (F.count_if("fails") == 0).alias("passed"))


def join_labels(predicted: DataFrame, labels: DataFrame, on: str = "call_id", how: str = "inner") -> DataFrame:
    """Predictions beside the labels of their call; a label column that has a prediction's name gets ``gold_`` before it."""
    named = [F.col(c).alias(f"gold_{c}" if c in predicted.columns and c != on else c) for c in labels.columns]
    return predicted.join(labels.select(*named), on, how)


def set_counts(pairs: DataFrame, expected: str, actual: str) -> DataFrame:
    """Adds tp, fp and fn of two label lists, each taken as a set; a null list is empty."""
    as_set = lambda c: F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))))
    e, a = as_set(expected), as_set(actual)
    return pairs.withColumns({"tp": F.size(F.array_intersect(e, a)), "fp": F.size(F.array_except(a, e)), "fn": F.size(F.array_except(e, a))})


def label_set_prf(pairs: DataFrame, expected: str, actual: str, per_label: bool = False, beta: float = 1.0) -> DataFrame:
    """Precision, recall and F of label lists over all rows, or for each label that either list names."""
    if not per_label:
        sums = set_counts(pairs, expected, actual).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
        return prf(sums, beta)
    as_set = lambda c: F.array_compact(F.coalesce(c, F.array().cast("array<string>")))
    e, a = as_set(expected), as_set(actual)
    named = F.transform(F.array_union(e, a), lambda x: F.struct(x.alias("label"), F.array_contains(e, x).alias("e"), F.array_contains(a, x).alias("a")))
    one = pairs.select(F.explode_outer(named).alias("s")).where("s is not null").select("s.*")
    return prf(one.groupBy("label").agg(F.count_if(F.expr("e and a")).alias("tp"), F.count_if(F.expr("a and not e")).alias("fp"), F.count_if(F.expr("e and not a")).alias("fn")), beta)


def sentiment_error(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of rows whose mood moves the labelled way (no move counts as up), and the mean error of the move.

    Rows have sentiment_start, sentiment_end and their gold_ twins.
    """
    want, got = F.col("gold_sentiment_end") - F.col("gold_sentiment_start"), F.col("sentiment_end") - F.col("sentiment_start")
    right = (want >= 0) == (got >= 0)
    return pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(right.cast("double")), 6).alias("direction_accuracy"), F.round(F.avg(F.abs(want - got)), 6).alias("delta_error")
    )


def corpus_profile(calls: DataFrame, turns: DataFrame, spans: DataFrame) -> DataFrame:
    """(what, name, n): calls by category, spans by type and by surface form, and the totals (name ``all``)."""
    n = F.count(F.lit(1)).alias("n")

    def by(df: DataFrame, what: str, column: str) -> DataFrame:
        return df.groupBy(F.lit(what).alias("what"), F.col(column).alias("name")).agg(n)

    parts = [by(calls, "category", "category"), by(spans, "type", "type"), by(spans, "surface_form", "surface_form")]
    parts += [df.groupBy(F.lit(what).alias("what"), F.lit("all").alias("name")).agg(n) for df, what in ((calls, "calls"), (turns, "turns"), (spans, "spans"))]
    return reduce(DataFrame.unionByName, parts)


def capacity(latency: DataFrame, budget_ms: float, level: str = "level", exact: bool = True) -> DataFrame:
    """Per level its p50, p95 and p99 and verdict; ``sustained`` until the first level whose p95 is over budget, ``most`` the highest such level."""
    at = lambda q: F.round(quantile("duration_ms", q, exact), 3)
    by = latency.groupBy(F.col(level).alias("level")).agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"))
    breach = by.agg(F.min(F.when(F.col("p95_ms") > budget_ms, F.col("level"))).alias("breach"))  # one row
    out = by.crossJoin(F.broadcast(breach)).withColumn("sustained", F.col("breach").isNull() | (F.col("level") < F.col("breach")))
    most = out.agg(F.max(F.when(F.col("sustained"), F.col("level"))).alias("most"))  # one row
    return out.crossJoin(F.broadcast(most)).select("level", "p50_ms", "p95_ms", "p99_ms", (F.col("p95_ms") <= budget_ms).alias("within"), "sustained", "most")
