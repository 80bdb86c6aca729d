"""The search for leaks reads a text once."""

from callscope.operators import scoring


def test_leaks_read_a_text_once(spark):
    values = spark.createDataFrame([(1, "98765"), (1, "Maria Lopez")], "call_id long, value string")
    said = spark.createDataFrame([(1, 0, "nine eight, seven six five"), (1, 1, "Maria Lopez"), (2, 0, "98765")], "call_id long, seq long, text string")
    out = scoring.find_leaks(values, said)
    assert "[^a-z0-9]+" not in out._jdf.queryExecution().optimizedPlan().toString()  # the words of the texts are settled, not worked out in each use
    assert {r.value: r.space for r in out.collect()} == {"98765": "spoken", "Maria Lopez": "raw"}
