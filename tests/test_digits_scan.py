"""Texts without a match are only searched, and numbers are found without a look at every word."""

import random
import re

from callscope.functions import digits
from callscope.operators import pii


def test_texts_without_a_match_are_only_searched(spark):
    df = spark.createDataFrame([(1, 0, "x")], "call_id long, seq long, text string")
    plan = pii.pii_spans(df, ["person_trigger"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and plan.count("regexp_extract_all") == 1


def _word_by_word(text):
    """The digits of a text, read token by token."""
    found, places, ends, fillers, times, round_ten = [], [], [], 0, 1, False
    for m in re.finditer(r"[0-9]+|[A-Za-z']+|[^\w\s]", text):
        word, place = m.group().lower(), m.span()
        after_ten, round_ten = round_ten, False
        if word in digits.UNITS and after_ten and digits.UNITS[word] != "0":
            found[-1], places[-1], fillers, times = digits.UNITS[word], place, 0, 1
        elif word in digits.UNITS or word.isdigit():
            own = digits.UNITS[word] * times if word in digits.UNITS else word
            found += own
            places += [place] * times if word in digits.UNITS else [(k, k + 1) for k in range(*place)]
            fillers, times = 0, 1
        elif word in digits.TEENS or word in digits.TENS:
            found += digits.TEENS.get(word) or digits.TENS[word] + "0"
            places += [place] * 2
            fillers, times, round_ten = 0, 1, word in digits.TENS
        elif word in digits.REPEATS:
            fillers, times = 0, digits.REPEATS[word]
        else:
            times, fillers = 1, fillers + word.isalpha()
            if word in digits.STOPS or fillers > digits.FILLERS:
                ends += [len(found)] * (bool(found) and (not ends or ends[-1] != len(found)))
                fillers = 0
    return "".join(found), places, [e for e in ends if e < len(found)]


def test_digits_against_a_scan_of_every_word():
    r = random.Random(3)
    words = [*digits.UNITS, *digits.TEENS, *digits.TENS, *digits.REPEATS, "the", "and", "it's", "'one", "one's", "é", "_", "²", "ones", "bone", "ſix", "12", "5", "407", "a1b", "x9", "One", "TWENTY"]
    for _ in range(20_000):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", ". ", ", ", "? ", "", "\n", "'", "; ", "_"]) for _ in range(r.randrange(14)))
        assert digits.read_digits(text) == _word_by_word(text), text


def test_spoken_emails_with_each_domain(spark):
    texts = [f"write ana dot lee at example dot {d} then" for d in ("com", "Org", "net", "edu", "GOV", "io", "co")] + ["ana at example dot comx", "ana at co dot x1", "éco ana at b dot xy"]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "call_id long, seq long, text string")
    assert sorted(r.call_id for r in pii.pii_spans(df, ["spoken_email"]).collect()) == [0, 1, 2, 3, 4, 5, 6, 8]
