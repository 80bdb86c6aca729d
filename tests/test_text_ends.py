"""Texts whose ends or letters Java's patterns read otherwise than the SQL's."""

import duckdb
import pytest
from pyspark.sql import functions as F

from callscope import plans
from callscope.operators import pii, scoring

ENDS = ["so it was eraned.\n", "so it was eraned.\r\n", "? one\x0btwo \x0b", "\xa0three four\xa0 ", "five! ", " six .\n ", "…seven…", "\n", "", "eight nine. "]


def test_normalised_ends_are_those_of_the_sql(spark):
    sql = "select trim(regexp_replace(regexp_replace(lower(t), '^[ .,!?…]+|[ .,!?…]+$', '', 'g'), '\\s+', ' ', 'g')) from (select unnest(?) as t)"
    want = [r[0] for r in duckdb.execute(sql, [ENDS]).fetchall()]
    assert [r.n for r in spark.createDataFrame([(t,) for t in ENDS], "t string").coalesce(1).select(scoring.normalise(F.col("t")).alias("n")).collect()] == want


def test_a_line_break_keeps_the_mark_before_it(spark):
    items = spark.createDataFrame([(1, 1, "no eraned.\n"), (2, 2, "no eraned.")], "id long, call_id long, item string")
    said = spark.createDataFrame([(1, "it was eraned then"), (2, "it was eraned then")], "call_id long, description string")
    assert {r.call_id: r.found for r in scoring.action_recall(items, said).collect()} == {1: 0, 2: 1}


BORDERED = [
    "at 0.53.96 das ist die stä auf", "ü12 Old Mill Road", "12 Old Mill Roadé", "12 Old Mill st, apt 4é", "éana@x.org, -ana@x.orgé ana@x.orgs", "é123-45-6789 123-45-6789é 123-45-67890", "é555-010-1234é", "é4/5/1980é 4/5/19801",
    "äMay 4th, 1980ö", "3 June 2021ü", "ßaccount 12345-678é", "é4111 1111 1111 1111é", "éMy name is Ana Lee", "éana dot lee at example dot comé", "12\x0bOld Mill Road", "123\x0b45.6789", "my name is\x0bAna Lee", "12 Old\tMill\r\nRoad",
]


@pytest.mark.parametrize("kind", [k for k in pii.DETECTORS if k != "person_run"])
def test_word_borders_are_those_of_the_sql(spark, kind):
    rows = list(enumerate(BORDERED))
    values = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in rows)
    want = duckdb.execute(plans.spans_sql(kind, pii.DETECTORS[kind][2], f"(select * from (values {values}) v(doc_id, text))")).fetchall()
    found = pii.pii_spans(spark.createDataFrame([(i, 0, t) for i, t in rows], "call_id long, seq long, text string").coalesce(1), [kind])
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert want
