"""Exact order statistics of large keys by selection, without a sort of any key's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that a pass counts, and how many values of a range are put in order at once.
RANGES, LEFT = 512, 4096


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once, with a short lineage where the session has a checkpoint folder."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _picked(hist: Column, skip: Column) -> Column:
    """The range that holds the value with ``skip`` smaller ones, and how many stand before it: a fold over at most ``RANGES`` counts."""
    begin = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("struct<k:bigint,n:bigint,lo:double,hi:double>").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["before"] + x["n"] > skip
        found = F.struct(acc["before"].alias("before"), x.alias("at"))
        passed = F.struct((acc["before"] + x["n"]).alias("before"), acc["at"].alias("at"))
        return F.when(acc["at"].isNotNull(), acc).when(here, found).otherwise(passed)

    return F.aggregate(hist, begin, step)


def _selected(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(__key, rank, value) of ``rows`` (__key, __v) and ``ranks`` (__key, rank); keys are structs, so null parts meet each other."""
    whole = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    known = ranks.distinct().join(whole, "__key").where((F.col("rank") >= 0) & (F.col("rank") < F.col("__n")))
    open_ = settled(known.withColumn("__skip", F.col("rank").cast("long")))
    bounds = ["__key", "__lo", "__hi"]
    wide = (F.col("__n") > LEFT) & (F.col("__lo") < F.col("__hi"))
    while not open_.where(wide).isEmpty():
        inside = rows.join(open_.where(wide).select(*bounds).distinct(), "__key").where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
        k = F.least(F.lit(RANGES - 1), F.floor((F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * RANGES)).alias("k")
        counted = inside.groupBy(*bounds, k).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        hist = counted.groupBy(*bounds).agg(F.array_sort(F.collect_list(F.struct("k", "n", "lo", "hi"))).alias("hist"))  # RANGES at most
        met = open_.join(hist, bounds, "left").withColumn("p", F.when(F.col("hist").isNotNull(), _picked(F.col("hist"), F.col("__skip"))))
        skip = (F.col("__skip") - F.coalesce("p.before", F.lit(0))).alias("__skip")
        open_ = settled(met.select("__key", "rank", F.coalesce("p.at.lo", "__lo").alias("__lo"), F.coalesce("p.at.hi", "__hi").alias("__hi"), F.coalesce("p.at.n", "__n").alias("__n"), skip))
    few = rows.join(open_.where("__lo < __hi").select(*bounds).distinct(), "__key").where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
    ordered = few.groupBy(*bounds).agg(F.array_sort(F.collect_list("__v")).alias("__all"))  # LEFT values at most
    out = open_.join(ordered, bounds, "left")
    return out.select("__key", "rank", F.coalesce(F.get("__all", F.col("__skip").cast("int")), F.col("__lo")).alias("value"))


def _rows(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(F.struct(*by).alias("__key"), F.col(value).cast("double").alias("__v"))


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """(by, rank, value) of ``ranks`` (by, rank from 0): the values at those places in the order of each key's values that aren't null.

    Each pass counts the values of equal ranges between the bounds of what is left, with partial counts in the tasks, and goes on in the
    one range that holds the rank, between the least and the greatest value there. Once at most ``LEFT`` values are left in every range,
    these are put in order. A key's values meet nowhere else. Ranks that a key doesn't have are left out; a null key is a key.
    """
    out = _selected(_rows(df, by, value), ranks.select(F.struct(*by).alias("__key"), "rank"))
    return out.select(*[F.col(f"__key.{c}").alias(c) for c in by], "rank", "value")


def selected_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, a column a quantile): what ``percentile`` gives, linear between the two nearest values, by ``order_statistics``."""
    rows = _rows(df, by, value)
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in quantiles.items()])
    asked = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).select("__key", "n", F.explode(listed).alias("x"))
    asked = asked.select("__key", "x.name", (F.col("x.q") * (F.col("n") - 1)).alias("at"))
    asked = asked.withColumns({"low": F.floor("at").cast("long"), "high": F.ceil("at").cast("long")})
    found = _selected(rows, asked.select("__key", F.col("low").alias("rank")).union(asked.select("__key", "high")))
    of = lambda c: found.select("__key", F.col("rank").alias(c), F.col("value").alias(f"v_{c}"))
    both = asked.join(of("low"), ["__key", "low"]).join(of("high"), ["__key", "high"])
    exact = F.when(F.col("low") == F.col("high"), F.col("v_low")).otherwise((F.col("high") - F.col("at")) * F.col("v_low") + (F.col("at") - F.col("low")) * F.col("v_high"))
    out = both.groupBy("__key").agg(*[F.max(F.when(F.col("name") == name, exact)).alias(name) for name in quantiles])
    return out.select(*[F.col(f"__key.{c}").alias(c) for c in by], *quantiles)
