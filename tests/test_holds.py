"""Held numbers: literal calls, a plain loop beside the Spark fold, and the stream."""

import re
import tempfile
from datetime import datetime, timedelta

from callscope.operators import holds
from callscope.testdata import turns

SCHEMA = "call_id string, seq long, text string"


def _redacted(spark, *texts):
    rows = holds.redact_calls(spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], SCHEMA)).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: (r["seq"], r["part"]))]


def test_split_card_is_one_placeholder(spark):
    out = " ".join(_redacted(spark, "Okay, the card number, first part is 4000 0566", "and the rest is 5566 5556.", "Thank you."))
    assert out.count("<CARD_1>") == 1 and not re.search(r"\d{3}", out)


def test_fragments_never_go_out(spark):
    out = _redacted(spark, "My account number is 4417", "Go ahead.", "Yes.")
    assert "4417" not in " ".join(out) and "<ACCOUNT_1>" in " ".join(out)
    out = _redacted(spark, "the card starts with 4417")
    assert out[0] == "the card starts with" and out[1] == "<ACCOUNT_1>"  # the end of the call gives out what is held
    out = " ".join(_redacted(spark, "card number 4242.", "4242.", "4242.", "4242.", "ok"))
    assert not re.search(r"4242", out)


def test_plain_numbers_stay(spark):
    assert _redacted(spark, "It rained for 300 days. Then it stopped.", "I paid 25 dollars") == ["It rained for 300 days. Then it stopped.", "I paid 25 dollars"]


def test_partials_withhold(spark):
    rows = [("a", 0, "Let me just read it out.", True), ("a", 1, "It's 520808.", False), ("a", 2, "email me at jo.doe@exam", False), ("a", 3, "It's sunny.", True)]
    got = {r["seq"]: r["text"] for r in holds.preview_partials(spark.createDataFrame(rows, SCHEMA + ", is_final boolean")).collect()}
    assert got == {1: "It's", 2: "email me at"}
    final = holds.hold_calls(spark.createDataFrame(rows, SCHEMA + ", is_final boolean")).where("is_final").collect()
    assert sorted((r["seq"], r["text"]) for r in final) == [(0, "Let me just read it out."), (3, "It's sunny.")]  # partials change nothing


def test_odd_rows(spark):
    rows = [(None, 0, "card 4242"), ("a", 0, None), ("a", 1, ""), ("b", 0, "card 4242"), ("b", 1, None), ("b", 1, "4242")]
    got = holds.hold_calls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["part"] == 0 for r in got) == len(rows)
    assert [r["text"] for r in got if r["call_id"] is None] == ["card 4242"]
    assert holds.redact_calls(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fold_matches_a_plain_loop(spark):
    df = turns(spark, "/root/testdata/sf0.001").selectExpr("call_id", "seq", "if(seq % 3 = 0, concat(text, ' card number ', 4000 + call_id), text) as text")
    want, held = [], {}
    for r in sorted(df.collect(), key=lambda r: (r["call_id"], r["seq"])):
        given, held[r["call_id"]] = holds.step(held.get(r["call_id"], holds.Held()), r["text"])
        want.append((r["call_id"], r["seq"], 0, given["text"]))
        last = {c: s for c, s, _, _ in want}
    want += [(c, last[c], 1, rest["text"]) for c, h in held.items() if (rest := holds.flush(h))]
    got = [(r["call_id"], r["seq"], r["part"], r["text"]) for r in holds.hold_calls(df).collect()]
    assert sorted(got) == sorted(want)


def test_stream_keeps_state_between_batches(spark):
    folder, start = tempfile.mkdtemp(prefix="spark-"), datetime(2024, 1, 1)
    batches = [
        [("a", 0, "the card number, first part is 4000 0566", 0, False), ("b", 0, "my account ends 4417", 0, False), ("c", 0, "policy 5512", 0, False)],
        [("a", 1, "and the rest is 5566 5556.", 5, False), ("c", 1, None, 6, True)],
        [("z", 0, "hello", 600, False)],
        [("z", 1, "hello", 1200, False)],
    ]
    schema = SCHEMA + ", emitted_at timestamp, ended boolean"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(c, s, t, start + timedelta(seconds=at), e) for c, s, t, at, e in rows], schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    q = holds.hold_stream(stream, b"a secret of the tests").writeStream.format("memory").queryName("held").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(90)
    rows = spark.sql("select * from held").collect()
    text = {(r["call_id"], r["seq"], r["part"]): r["text"] for r in rows}
    assert text["a", 0, 0] == "the card number, first part is" and "4000 0566 and the rest is 5566 5556" in text["a", 1, 0]
    assert text["b", 0, 1] == "4417"  # silence
    assert text["c", 1, 1] == "5512"  # the end marker
