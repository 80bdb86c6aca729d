import random

from pyspark.sql import functions as F

from callscope.operators import scoring, signals
from callscope.sources import load_policies, read_calls

COLUMNS = "call_id long, idx long, signal_type string, policy_id string, label string, severity string, confidence double, anchor long"


def test_repeats_against_a_plain_loop(spark):
    rng = random.Random(3)
    kinds = ["compliance_violation", "intent", "sentiment_shift", "escalation_risk"]
    rows = [(c, i, rng.choice(kinds), rng.choice(["P1", "P2"]), rng.choice("ab"), rng.choice(["medium", "high"]), round(rng.random(), 3), rng.randrange(3)) for c in range(6) for i in range(60)]
    want, last = [], {}
    for r in rows:
        call, _, kind, policy, label, level, sure, anchor = r
        key = (call, kind, policy) if kind == kinds[0] else (call, kind)
        old = last.get(key)
        if kind == kinds[0]:
            news = old is None
        elif old is None:
            news = True
        elif kind == "intent":
            news = label != old[0]
        elif kind == "sentiment_shift":
            news = (label, anchor) != (old[0], old[3])
        else:
            news = (label, level) != old[:2] or sure - old[2] >= 0.15
        if news:
            want.append(r)
            last[key] = (label, level, round(sure, 2), anchor)
    out = signals.suppress_repeats(spark.createDataFrame(rows, COLUMNS))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert signals.suppress_repeats(spark.createDataFrame([], COLUMNS)).count() == 0


def test_leaks_in_three_spaces(spark):
    values = spark.createDataFrame([(1, "4111-1111"), (1, "98765"), (1, "a@example.com"), (1, "Maria Lopez"), (1, "12"), (2, "55555"), (1, None)], "call_id long, value string")
    said = spark.createDataFrame([(1, 0, "x 4111"), (1, 1, "1111. nine eight, seven six five"), (1, 2, "Maria Lopez"), (1, 3, None)], "call_id long, seq long, text string")
    out = {r.value: r.space for r in scoring.find_leaks(values, said).collect()}
    assert out == {"4111-1111": "digits", "98765": "spoken", "a@example.com": "", "Maria Lopez": "raw", "12": "", "55555": "", None: ""}


def test_coverage_of_digits_and_letters(spark):
    texts = spark.createDataFrame([(1, 0, "ACCT-12345 Maria Lopez")], "call_id long, seq long, text string")
    labels = spark.createDataFrame([(1, 0, "ACCOUNT", 0, 10), (1, 0, "PERSON", 11, 22), (1, 0, "NON_CARD", 0, 0)], "call_id long, seq long, type string, start int, end int")
    spans = spark.createDataFrame([(1, 0, "CARD", 5, 8, "a"), (1, 0, "CARD", 8, 10, "b"), (1, 0, "PERSON", 12, 21, "n")], "call_id long, seq long, type string, start int, end int, detector string")
    out = {r.type: (r.covered, r.type_correct, r.detector) for r in scoring.span_coverage(labels, spans, texts).collect()}
    assert out == {"ACCOUNT": (True, False, "a"), "PERSON": (False, False, None), "NON_CARD": (False, False, None)}
    assert scoring.false_positives(spans, labels.where("type = 'ACCOUNT'")).collect()[0].asDict() == {"type": "PERSON", "false_positives": 1}


def test_quotes_and_grounding(spark):
    turns = spark.createDataFrame([(1, 0, "a" * 50 + " hit " + "b" * 50), (1, 1, None)], "call_id long, seq long, text string")
    hit = spark.createDataFrame([(1, 0, 51, 54)], "call_id long, seq long, start int, end int")
    assert signals.with_quotes(hit, turns).collect()[0].quote == "..." + "a" * 44 + " hit " + "b" * 44 + "..."
    claims = spark.createDataFrame([(1, 0, "compliance_violation", "P1"), (1, 0, "compliance_violation", "P9"), (1, 5, "intent", None), (1, 1, "intent", None)], "call_id long, seq long, signal_type string, policy_id string")
    out = signals.ground_claims(claims, turns, spark.createDataFrame([("P1",)], "policy_id string"))
    assert [r.reason for r in out.orderBy("seq", F.col("policy_id")).collect()] == [None, "no_policy", None, "no_turn"]


def test_call_files_and_catalog(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"call_id": "c", "category": "clean", "turns": [{"idx": 0, "speaker": "agent",\n "text": "hi", "pii": []}, {"idx": 1, "speaker": "customer", "text": "4111", "pii": [{"type": "CARD", "start": 0, "end": 4, "value": "4111"}]}], "labels": {"resolution": "resolved"}}')
    (tmp_path / "b.json").write_text("{broken")
    turns, spans, labels = read_calls(spark, str(tmp_path))
    assert turns.count() == 2 and [(r.seq, r.type) for r in spans.collect()] == [(1, "CARD")] and labels.collect()[0].resolution == "resolved"
    policies, phrases = load_policies(spark, [{"id": "A", "applies_when": "intent in [x, 'y']", "prohibited_phrases": ["no"]}, {"id": "B"}])
    assert {r.policy_id: (list(r.intents), r.severity) for r in policies.collect()} == {"A": (["x", "y"], "medium"), "B": ([], "medium")}
    assert [(r.policy_id, r.use, r.phrase) for r in phrases.collect()] == [("A", "prohibited", "no")]


def plain_leaks(values, turns):
    """The definition: a call's turns put together, and its three readings."""
    import re

    words = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    out = []
    for call, value in values:
        emitted = "\n".join(t for c, _, t in sorted((x for x in turns if x[2] is not None), key=lambda x: x[:2]) if c == call)
        digits, raw = re.sub("[^0-9]", "", value), value.strip(" ")
        space = ""
        if len(digits) >= 5:
            spoken = " ".join(words[int(d)] for d in digits)
            if digits in re.sub("[^0-9]", "", emitted):
                space = "digits"
            elif spoken in re.sub("[^a-z0-9]+", " ", emitted.lower()).strip():
                space = "spoken"
        elif ("@" in value or (digits == "" and len(raw) >= 5)) and raw in emitted:
            space = "raw"
        out.append((call, value, space))
    return out


def test_leaks_through_postings_are_those_of_the_definition(spark):
    import random

    r = random.Random(4)
    words = ["zero", "one"] * 9 + ["someone", "zeroed", "so", "ana.lee@example.org", "Ana Lee", "x@y"]
    turns = []
    for call in range(12):
        for seq in range(14):
            turns.append((call, seq, r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randrange(9))), "".join(r.choice("01- ") for _ in range(r.randrange(12)))])))
    turns += [(90, 0, "call 12"), (90, 1, "3"), (90, 2, "no"), (90, 3, "45 and 99999999"), (91, 0, "it is one"), (91, 1, "two three"), (91, 2, "one twofold"), (92, 0, "first line"), (92, 1, "second")]
    values = [(c, "".join(r.choice("01") for _ in range(r.choice((5, 6, 9, 12))))) for c in range(12) for _ in range(6)]
    values += [(c, v) for c in range(13) for v in ("ana.lee@example.org", "Ana Lee", "x@y", "lee@example", "a Lee ana", "one two three", "1", "", "Lee so")]
    values += [(90, "1-2345"), (90, "999999999"), (90, "99999"), (91, "12312"), (91, "12313"), (92, "line\nsecond"), (92, "line second"), (93, "12345")]
    values = sorted(set(values))
    got = scoring.find_leaks(spark.createDataFrame(values, "call_id int, value string"), spark.createDataFrame(turns, "call_id int, seq int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(plain_leaks(values, turns))
    spaces = [r.space for r in got.collect()]
    assert min(spaces.count(x) for x in ("digits", "spoken", "raw", "")) > 0
