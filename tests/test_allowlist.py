"""Filters of the detectors: types, confidence, allowed names, and the number that a word beside it makes surer."""

from pyspark.sql import functions as F

from callscope.operators import pii

SCHEMA = "call_id string, seq long, text string, names array<string>"
TEXT = "Hello, my name is Priya Nair, write to jo@example.com"


def _found(spark, rows, **how):
    rows = pii.detect_pii(spark.createDataFrame(rows, SCHEMA), ["person_trigger", "email", "ssn"], **how).select("call_id", F.explode_outer("spans").alias("s"))
    return sorted((r["call_id"], r["s"]["type"], r["s"]["value"], r["s"]["confidence"]) for r in rows.where("s is not null").collect())


def test_allowed_names(spark):
    rows = [("a", 0, TEXT, ["priya nair"]), ("b", 0, TEXT, None), ("c", 0, "my name is Priya", ["Priya Nair", None]), ("d", 0, None, ["x"])]
    got = _found(spark, rows, allowed=F.col("names"))
    assert [g[:3] for g in got] == [("a", "EMAIL", "jo@example.com"), ("b", "EMAIL", "jo@example.com"), ("b", "PERSON", "Priya Nair")]


def test_types_and_confidence(spark):
    rows = [("a", 0, TEXT, None)]
    assert [g[1] for g in _found(spark, rows, types=["PERSON"])] == ["PERSON"]
    assert [g[1] for g in _found(spark, rows, least=0.9)] == ["EMAIL"]
    assert _found(spark, rows, types=[]) == []


def test_social_is_surer_beside_its_word(spark):
    rows = [("a", 0, "my social is 900-12-3456", None), ("b", 0, "it reads 900-12-3456", None)]
    assert [(g[0], g[3]) for g in _found(spark, rows)] == [("a", 0.97), ("b", 0.8)]
