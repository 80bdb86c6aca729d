from pyspark.sql import functions as F

from callscope.functions.spans import match_spans
from callscope.operators import contracts, conversation, pii, quality
from callscope.sources import read_segments, write_fact
from callscope.streaming import close_calls, dedupe_stream


def texts(spark, *rows):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "call_id long, seq long, text string")


def test_spans_count_code_points(spark):
    df = texts(spark, "café 😀 a@b.io and c@d.org", "", None, "none")
    spans = df.where("text is not null").select(match_spans(F.col("text"), r"\S+@\S+").alias("s")).collect()
    assert [(s.start, s.end, s.value) for s in spans[0].s] == [(7, 13, "a@b.io"), (18, 25, "c@d.org")]
    assert [len(r.s) for r in spans] == [2, 0, 0]


def test_redaction_numbers_values_per_call(spark):
    df = texts(spark, "mail a@example.com or call (415) 555-0134", "again A@EXAMPLE.com, and b@example.com", None, "no data")
    out = {r.seq: r.text for r in pii.redact(df).collect()}
    assert out[0] == "mail <EMAIL_1> or call <PHONE_1>" and out[1] == "again <EMAIL_1>, and <EMAIL_2>" and out[2] is None and out[3] == "no data"


def test_redaction_finds_spoken_and_bare_numbers(spark):
    df = texts(spark, "reach me on four one five five five five oh one three four", "my social is 900123456", "the account is 12345678 or so", "born on 04121987 she was", None, "", "it rained for 300 days")
    out = {r.seq: (r.text, r.n_redactions) for r in pii.redact(df).collect()}
    assert out[0] == ("reach me on <PHONE_1>", 1) and out[1] == ("my social is <SSN_1>", 1)
    assert out[2] == ("the account is <ACCOUNT_1> or so", 1) and out[3] == ("born on <DOB_1> she was", 1)
    assert out[4] == (None, 0) and out[5] == ("", 0) and out[6] == ("it rained for 300 days", 0)
    assert [r.placeholder for r in pii.assign_placeholders(pii.detect_pii(df)).orderBy("seq").collect()] == ["<PHONE_1>", "<SSN_1>", "<ACCOUNT_1>", "<DOB_1>"]


def test_overlaps_keep_the_type_that_comes_first(spark):
    out = pii.detect_pii(texts(spark, "card 4111 1111 1111 1111 here")).collect()
    assert [(s.type, s.start, s.end) for s in out[0].spans] == [("CARD", 5, 24)]


def test_contract_reasons(spark):
    schema = "call_id string, seq int, speaker string, text string, start_ms int, end_ms int, asr_confidence double, emitted_at string, schema_version string, redactions array<struct<start:int,end:int,placeholder:string,confidence:double>>"
    ok = ("c", 0, "agent", "café card <CARD_1> ok", 0, 5, 0.5, "t", "1.0", [(10, 18, "<CARD_1>", 0.9)])
    change = lambda **k: tuple(k.get(n, v) for n, v in zip([c.split()[0] for c in schema.split(", ")][:10], ok, strict=False))
    rows = [ok, change(call_id=""), change(seq=-1), change(speaker="operator"), change(start_ms=9), change(start_ms=-1), change(asr_confidence=1.5), change(emitted_at=None),
            change(schema_version="2.0"), change(text="x" * 9000), change(redactions=[(9, 17, "<CARD_1>", 0.9)]), change(redactions=[(10, 99, "<CARD_1>", 0.9)])]
    out = contracts.validate_segments(spark.createDataFrame(rows, schema)).collect()
    assert [list(r.reasons) for r in out] == [[], ["call_id"], ["seq"], ["speaker"], ["times"], ["times"], ["confidence"], ["emitted_at"], ["version"], ["text", "spans"], ["spans"], ["spans"]]


def test_scrub(spark):
    out = [r.text for r in contracts.scrub(texts(spark, "4111 1111 1111 1111", "a@b.com", "seq=42"), "text").orderBy("seq").collect()]
    assert out == ["[digits]", "[email]", "seq=42"]


def test_sentiment_negation(spark):
    df = spark.createDataFrame([(1, 0, "customer", "not happy"), (1, 1, "customer", "very happy"), (1, 2, "customer", ""), (1, 3, "customer", None)], "call_id long, seq long, speaker string, text string")
    out = [round(r.sentiment, 4) for r in conversation.score_sentiment(df, {"happy": 0.6}, ["not"], {"very": 1.4}).orderBy("seq").collect()]
    assert out == [-0.648, 1.0, 0.0, 0.0]


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 11)], "k string, v double")
    assert [r.value for r in quality.nearest_rank(df, "v", "k", 0.95).collect()] == [10.0]


def test_segment_files_rejects_facts_and_dedupe(spark, tmp_path):
    lines = ['{"call_id":"a","seq":1,"is_final":true,"text":"x","emitted_at":"2024-01-01T00:00:00Z"}'] * 5 + ["{broken", '{"seq":2}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    good, bad = read_segments(spark, str(tmp_path / "in"))
    assert good.count() == 5 and bad.count() == 2
    write_fact(good.select("call_id", "seq", "emitted_at"), str(tmp_path / "fact"), "emitted_at")
    assert spark.read.parquet(str(tmp_path / "fact")).where("month = 202401").count() == 5
    stream, _ = read_segments(spark, str(tmp_path / "in"), streaming=True)
    run = dedupe_stream(stream).writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("deduped").count() == contracts.dedupe_segments(good).count() == 1
    assert close_calls(good.where("emitted_at is not null")).count() == 1
