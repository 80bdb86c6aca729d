import re

from callscope.functions.digits import claims, luhn, read_digits
from callscope.operators import pii


def rows(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "call_id long, seq long, text string")


def test_digits_spoken_and_typed():
    say = lambda t: (read_digits(t)[0], read_digits(t)[2])
    assert say("forty two, double four, oh seven, thirteen and 56") == ("4244071356", [])
    assert say("forty, two fifty") == ("40250", [])
    assert say("one two. three") == ("123", [2])
    assert say("one a b c d e two") == ("12", []) and say("one a b c d e f two") == ("12", [1])
    assert say("to for too") == ("", []) and say("") == ("", []) and say("seven. ") == ("7", [])
    assert read_digits("x forty two")[1] == [(2, 7), (8, 11)]


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and not luhn("0" * 11)


def test_claims():
    card = "four one one one one one one one one one one one one one one one"
    assert claims(card) == [("CARD", 0, len(card), 0.99)]
    assert claims("my card is 4111 1111 1111 1112") == [("CARD", 11, 30, 0.72)]
    assert claims("so 4111 1111 1111 1112") == [("CARD", 3, 22, 0.45)]
    assert claims("social 123 45 6789")[0][0] == "SSN" and claims("123456789") == [("ACCOUNT", 0, 9, 0.4)]
    assert claims("reach you at 4155550134") == [("PHONE", 13, 23, 0.9)] and claims("4155550134") == [("PHONE", 0, 10, 0.6)]
    assert claims("born 01021990")[0][0] == "DOB" and claims("press 12345") == [] and claims("12345", "the account") == [("ACCOUNT", 0, 5, 0.5)]
    assert claims("41555501340005") == [("PHONE", 0, 14, 0.6)]  # the digits left over join the claim
    assert claims(None) == claims("") == []


def test_digit_runs_as_spans(spark):
    df = rows(spark, "pay with card 4111 1111 1111 1111", None, "", "é 😀 4155550134", "none")
    out = [(r.seq, r.type, r.start, r.end, r.confidence) for r in pii.pii_spans(df, ["digit_runs"]).orderBy("seq").collect()]
    assert out == [(0, "CARD", 14, 33, 0.99), (3, "PHONE", 4, 14, 0.6)]
    assert [(r.seq, r.digits) for r in pii.digit_streams(df).orderBy("seq").collect()] == [(0, "4111111111111111"), (3, "4155550134")]
    assert pii.detect_pii(df, ["digit_runs", "phone"]).count() == 2


def test_names_and_spoken_email(spark):
    texts = ["My name is Maria Lopez and", "this is Okay", "we met Anna Maria Smith. Paul Jones said", "at Fenwick Road", "Paul Jones said", "j dot x at example dot com", "meet at four dot thirty", "I am  Li"]
    found = lambda *k: [(r.seq, texts[r.seq][r.start : r.end]) for r in pii.pii_spans(rows(spark, *texts), list(k)).orderBy("seq", "start").collect()]
    assert found("person_trigger") == [(0, "Maria Lopez"), (7, "Li")]
    assert found("person_run") == [(0, "Maria Lopez"), (2, "Anna Maria Smith")]
    assert found("spoken_email") == [(5, "j dot x at example dot com")]
    brute = [(i, m.group()) for i, t in enumerate(texts) for m in re.finditer(r"(?<![.!?]\s)(?<!^)\b[A-Z][a-z'\-]+(?:\s+[A-Z][a-z'\-]+)+", t)]
    assert set(found("person_run")) <= set(brute)
