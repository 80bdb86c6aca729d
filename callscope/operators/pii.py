"""Personal data in text: native span detection, overlaps, placeholders, redaction, leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.arrays import let, running
from callscope.functions.digits import CONTEXT, NEAR, digit_claims, digit_stream
from callscope.functions.spans import ascii_pattern, match_spans

#: The order in which types win overlaps, the months and street words.
PRIORITY = ("CARD", "SSN", "DOB", "PHONE", "ACCOUNT", "EMAIL", "PERSON", "ADDRESS")
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
STREETS = "lane|road|street|st|avenue|ave|boulevard|blvd|drive|dr|court|ct|way|place|pl|terrace|circle|parkway|highway"

UNIT = r"(?:,?\s*(?:apartment|apt|unit|suite|ste|flat|#)\.?\s*[\w\-]+)?"

#: What introduces a name.
NAME_TRIGGERS = (
    "my name is|this is|i'm|i am|speaking with|it's|name is|name on the account is|account holder is|"
    "calling for|on behalf of|the name is|under the name"
)

#: Kind, type, confidence and pattern; where a pattern has a group, the span is the group, and ends with the match.
DETECTORS = {
    "email": ("EMAIL", 0.99, r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    "ssn": ("SSN", 0.8, r"\b\d{3}[-\s.]\d{2}[-\s.]\d{4}\b"),
    "phone": ("PHONE", 0.95, r"(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]\d{3}[-.\s]\d{4}\b"),
    "dob_numeric": (
        "DOB", 0.75,
        r"\b(?:0?[1-9]|1[0-2])[/\-.](?:0?[1-9]|[12]\d|3[01])[/\-.](?:19|20)\d{2}\b"
        r"|\b(?:0?[1-9]|[12]\d|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:19|20)\d{2}\b",
    ),
    "dob_wordy": (
        "DOB", 0.7,
        rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+(?:19|20)?\d{{2}}\b"
        rf"|\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?(?:{MONTHS}),?\s+(?:19|20)?\d{{2}}\b",
    ),
    "account_labelled": ("ACCOUNT", 0.9, r"(?i)\b(?:acct|account|ac|a/c)\s*(?:no\.?|number|#)?\s*[-:#]?\s*(\d[\d\s-]{4,}\d)\b"),
    "address": ("ADDRESS", 0.8, rf"(?i)\b\d{{1,6}}\s+(?:[A-Z][\w'\-]*\s+){{1,4}}(?:{STREETS})\b{UNIT}"),
    "long_digits": ("CARD", 0.45, r"\b\d(?:[ -]?\d){12,18}\b"),
    "spoken_email": (
        "EMAIL", 0.85,
        r"(?i)\b[A-Za-z0-9]+(?:\s*(?:dot|\.)\s*[A-Za-z0-9]++)*+\s+at\s+[A-Za-z0-9]+(?:\s*(?:dot|\.)\s*[A-Za-z0-9]++\b)++",
    ),
    "person_trigger": ("PERSON", 0.75, rf"\b(?i:{NAME_TRIGGERS})\s+([A-Z][\w'\-]+(?:\s+[A-Z][\w'\-]+){{0,2}})"),
    "person_run": ("PERSON", 0.55, r"(?=[A-Z])(?<![.!?]\s)(?<!^)\b[A-Z][a-z'\-]+(?:\s+[A-Z][a-z'\-]++)++"),
}
GROUPED = ("account_labelled", "person_trigger")
#: The patterns as texts are scanned; that of person_run, which has no SQL, keeps word borders of all scripts.
PATTERNS = {kind: p if kind == "person_run" else ascii_pattern(p) for kind, (_, _, p) in DETECTORS.items()}

#: What a text must hold for a kind to be sought at all: a plain search, much cheaper than the pattern.
HOLDS = {
    "email": lambda t: t.contains("@"),
    "spoken_email": lambda t: t.rlike(r"(?i)\sat\s") & t.rlike(r"(?<![A-Za-z0-9_])(?=[a-zA-Z])(?i:com|org|net|edu|gov|io|co)(?![A-Za-z0-9_])"),
    **dict.fromkeys(("ssn", "phone", "dob_numeric", "dob_wordy", "account_labelled", "address", "long_digits"), lambda t: t.rlike("[0-9]")),
}

#: Kinds that are surer beside a word that tells their type, and how sure then.
SURER = {"ssn": 0.97, "dob_numeric": 0.95, "dob_wordy": 0.93}

#: Top-level domains of a spoken email; capitalised words that are no names.
DOMAINS = r"(?i)\b(com|org|net|edu|gov|io|co)\b"
NOT_NAMES = (
    "i|okay|ok|yes|no|thanks|thank|hi|hello|sorry|sure|please|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|"
    "september|october|november|december|northwind|financial|recovery|visa|mastercard|amex|discover|american|express"
)

#: What a match must fulfil beside its pattern.
ACCEPT = {
    "spoken_email": lambda v: v.rlike(DOMAINS),
    "person_trigger": lambda v: ~v.rlike(rf"(?i)^(?:{NOT_NAMES})(?:\s|$)"),
    "person_run": lambda v: ~v.rlike(rf"(?i)(?:^|\s)(?:{NOT_NAMES})(?:\s|$)") & ~v.rlike(rf"(?i)\b(?:{STREETS})\b"),
    "account_labelled": lambda v: F.length(F.regexp_replace(v, r"\D", "")) >= 5,
}
SPANS = "array<struct<rank:int,type:string,start:int,end:int,detector:string,confidence:double,value:string>>"


def spans_of(text: Column, kinds: list[str], context: Column | None = None) -> Column:
    """The spans that the kinds find, as one array. Materialise it (``once``) before naming it more than once."""

    def named(kind: str) -> Column:
        if kind == "digit_runs":
            rank = F.create_map(*[F.lit(x) for i, t in enumerate(PRIORITY) for x in (t, i)])
            return F.transform(digit_claims(text, context), lambda s: F.struct(
                rank[s["type"]].alias("rank"), s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"),
                F.lit(kind).alias("detector"), s["confidence"].alias("confidence"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("value"),
            ))
        type_, confidence, pattern = *DETECTORS[kind][:2], PATTERNS[kind]

        def sure(s: Column) -> Column:
            if kind not in SURER:
                return F.lit(confidence)
            at = F.greatest(s["start"] - NEAR, F.lit(0))
            around = F.lower(F.concat_ws(" ", F.lit("") if context is None else context, F.substring(text, at + 1, s["end"] + NEAR - at)))
            return F.when(F.exists(F.array(*map(F.lit, CONTEXT[type_])), lambda w: around.contains(w)), SURER[kind]).otherwise(confidence)

        own = lambda s: F.struct(
            F.lit(PRIORITY.index(type_)).alias("rank"), F.lit(type_).alias("type"), s["start"].alias("start"), s["end"].alias("end"),
            F.lit(kind).alias("detector"), sure(s).alias("confidence"), s["value"].alias("value"),
        )
        found = match_spans(text, pattern)
        if kind in GROUPED:  # the group stands at the match's end
            found = F.transform(found, lambda s: F.struct(s["end"].alias("end"), F.regexp_extract(s["value"], pattern, 1).alias("value")))
            found = F.transform(found, lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        spans = F.transform(F.filter(found, lambda s: ACCEPT[kind](s["value"])) if kind in ACCEPT else found, own)
        sought = HOLDS[kind](text) & text.rlike(pattern) if kind in HOLDS else text.rlike(pattern)
        return F.when(sought, spans).otherwise(F.array().cast(SPANS))

    return F.concat(*[named(k) for k in kinds])


def once(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """``keep`` and ``value`` under ``name``, worked out once a row: later uses can't be merged into it."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def pii_spans(df: DataFrame, kinds: list[str], keys: tuple[str, ...] = ("call_id", "seq")) -> DataFrame:
    """One row a span: keys, type, start, end, detector, confidence."""
    found = once(df.where(F.col("text").isNotNull()), "all", spans_of(F.col("text"), kinds), *keys)
    return found.select(*keys, F.explode("all").alias("s")).select(*keys, "s.type", "s.start", "s.end", "s.detector", "s.confidence")


def digit_streams(df: DataFrame, keys: tuple[str, ...] = ("call_id", "seq")) -> DataFrame:
    """(keys, digits, breaks) of the texts that have digits, typed or spoken."""
    out = df.where(F.col("text").isNotNull()).select(*keys, digit_stream(F.col("text")).alias("d"))
    return out.where(F.length("d.digits") > 0).select(*keys, "d.digits", "d.breaks")


def _kept(cluster: Column) -> Column:
    """Greedy within spans that hang together: by type, then length, confidence and place; a span that meets a kept one goes."""
    keyed = F.array_sort(F.transform(cluster, lambda s: F.struct(s["rank"].alias("a"), (s["start"] - s["end"]).alias("b"), (-s["confidence"]).alias("c"), s["start"].alias("d"), s.alias("s"))))
    return F.aggregate(
        keyed,
        F.slice(cluster, F.lit(1), F.lit(0)),
        lambda acc, k: F.when(F.exists(acc, lambda o: (o["start"] < k["s"]["end"]) & (k["s"]["start"] < o["end"])), acc).otherwise(F.concat(acc, F.array(k["s"]))),
    )


def resolve_overlaps(spans: Column) -> Column:
    """The spans that stay where some overlap, in clusters from left to right.

    A sweep by start with the running maximum of ends cuts the spans into clusters that don't meet; only within a cluster are spans
    compared, so a text of many matches takes time in proportion to them.
    """

    def swept(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), F.lit(-1), F.greatest)
        return let(reach, lambda m: clustered(s, F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(m, i - 1)))))

    def clustered(s: Column, begins: Column) -> Column:
        cut = lambda b: F.transform(b, lambda at, k: F.slice(s, at + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - at))
        return F.flatten(F.transform(let(begins, cut), _kept))

    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("s")))), lambda x: x["s"])
    return F.when(F.size(spans) > 1, let(ordered, swept)).otherwise(spans)


def detect_pii(
    df: DataFrame, kinds: list[str] | None = None, keys: tuple[str, ...] = ("call_id", "seq"), types: list[str] | None = None,
    least: float = 0.0, allowed: Column | None = None,
) -> DataFrame:
    """(keys, text, spans) with overlaps resolved, of the ``types`` (null: all) with a confidence of ``least``; all kinds unless ``kinds`` names some.

    ``allowed`` is a row's array of names: a PERSON or ADDRESS that equals one, or one word of it, without case, is no find. Null allows none.
    """
    rows = df.where(F.col("text").isNotNull())
    found = once(rows, "all", spans_of(F.col("text"), kinds or [*DETECTORS, "digit_runs"]), *rows.columns)
    keep = F.col("all")
    if types is not None:
        keep = F.filter(keep, lambda s: s["type"].isin(*types) if types else F.lit(False))
    if allowed is not None:
        names = F.transform(F.filter(F.coalesce(allowed, F.array().cast("array<string>")), lambda n: n.isNotNull()), F.lower)
        known = F.concat(names, F.flatten(F.transform(names, lambda n: F.split(n, r"\s+"))))
        keep = F.filter(keep, lambda s: ~(s["type"].isin("PERSON", "ADDRESS") & F.array_contains(known, F.lower(F.trim(s["value"])))))
    if least > 0:
        keep = F.filter(keep, lambda s: s["confidence"] >= least)
    if types is not None or allowed is not None or least > 0:
        found = once(found, "all", keep, *keys, "text")
    return once(found.where(F.size("all") > 0), "spans", resolve_overlaps(F.col("all")), *keys, "text")


def assign_placeholders(detected: DataFrame, keys: tuple[str, ...] = ("call_id", "seq")) -> DataFrame:
    """One row a span, with ``<TYPE_n>`` numbered per call in first-seen order of the value; the keys after the call's order its turns."""
    s = detected.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.type", "s.start", "s.end", "s.detector", "s.confidence", "s.value")
    digits = F.regexp_replace("value", r"\D", "")
    s = s.withColumn("key", F.when(F.length(digits) >= 4, digits).otherwise(F.lower("value")))
    s = s.withColumn("first", F.min(F.struct(*keys[1:], "start")).over(Window.partitionBy("call_id", "type", "key")))
    n = F.dense_rank().over(Window.partitionBy("call_id", "type").orderBy("first"))
    return s.withColumn("placeholder", F.concat(F.lit("<"), F.col("type"), F.lit("_"), n.cast("string"), F.lit(">"))).drop("key", "first", "value")


def redact(df: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(call_id, seq, text, n_redactions, redactions): spans replaced by their placeholders; other rows as they are."""
    return write_placeholders(df, detect_pii(df, kinds))


def write_placeholders(df: DataFrame, detected: DataFrame, keys: tuple[str, ...] = ("call_id", "seq")) -> DataFrame:
    """(keys, text, n_redactions, redactions) of the rows, with the placeholders of ``detected``'s spans.

    ``redactions`` are (type, placeholder, start, end, detector, confidence) in the places of the new text.
    The texts and the narrow table of marks meet by key; Catalyst broadcasts the marks where they are few.
    """
    mark = F.struct("start", "end", "placeholder", "type", "detector", "confidence")
    marks = assign_placeholders(detected, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(mark)).alias("marks"))
    joined = df.select(*keys, "text").join(marks, list(keys), "left")
    cut = lambda lo, n: F.substring(F.col("text"), lo, n)
    # What stands before each mark, and the mark: the pieces of the new text.
    before = F.transform("marks", lambda m, i: m["start"] - F.when(i > 0, F.get("marks", i - 1)["end"]).otherwise(0))
    pieces = F.zip_with("marks", "__gaps", lambda m, g: F.concat(cut(m["start"] - g + 1, g), m["placeholder"]))
    rest = F.element_at("marks", -1)["end"]
    text = F.concat(F.array_join("__pieces", ""), cut(rest + 1, F.length("text")))
    grown = F.transform("marks", lambda m: F.length(m["placeholder"]) - (m["end"] - m["start"]))

    def placed(m: Column, by: Column) -> Column:  # ``by``: how much longer the text has become up to the mark's end
        end = m["end"] + by
        return F.struct(
            m["type"].alias("type"), m["placeholder"].alias("placeholder"), (end - F.length(m["placeholder"])).alias("start"), end.alias("end"),
            m["detector"].alias("detector"), m["confidence"].alias("confidence"),
        )

    shifted = F.zip_with("marks", running(grown, F.lit(0), lambda a, b: a + b), placed)
    out = once(joined, "__gaps", before, *keys, "text", "marks")
    out = once(out, "__pieces", pieces, *keys, "text", "marks")
    none = F.array().cast(REDACTIONS)
    return out.select(*keys, F.coalesce(text, F.col("text")).alias("text"), F.coalesce(F.size("marks"), F.lit(0)).alias("n_redactions"), F.coalesce(shifted, none).alias("redactions"))


REDACTIONS = "array<struct<type:string,placeholder:string,start:int,end:int,detector:string,confidence:double>>"


def redaction_summary(spans: DataFrame) -> DataFrame:
    return spans.groupBy("type", "detector").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("call_id").alias("calls"))


def redactions_by_call(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(call_id, texts, redactions, redacted_texts) of every call of ``rows``; calls without a redaction have 0."""
    per_text = spans.groupBy("call_id", "seq").agg(F.count(F.lit(1)).alias("n"))
    per_call = per_text.groupBy("call_id").agg(F.sum("n").alias("redactions"), F.count(F.lit(1)).alias("redacted_texts"))
    calls = rows.groupBy("call_id").agg(F.count(F.lit(1)).alias("texts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return calls.join(per_call, "call_id", "left").select("call_id", "texts", zero("redactions"), zero("redacted_texts"))


def long_digit_runs(df: DataFrame, least: int = 7) -> DataFrame:
    """Rows whose text still holds a run of ``least`` digits or more."""
    return df.where(F.col("text").rlike(rf"[0-9]{{{least},}}")).select("call_id", "seq", F.size(F.regexp_extract_all("text", F.lit(rf"[0-9]{{{least},}}"), F.lit(0))).alias("runs"))


def luhn_filter(df: DataFrame, column: str) -> DataFrame:
    digits = F.regexp_replace(column, r"\D", "")
    return df.where((F.length(digits) >= 12) & F.call_function("luhn_check", digits))


def carry_context(turns: DataFrame, chars: int = 240) -> DataFrame:
    """The last ``chars`` characters of the call's earlier turns.

    A turn counts with its last ``chars`` characters and a separator, so no turn that begins more than twice as far back can matter:
    the window holds a bounded stretch of text, however long the call is.
    """
    call = Window.partitionBy("call_id")
    said = F.right("text", F.lit(chars))
    size = F.when(F.col("text").isNotNull(), F.length(said) + 1).otherwise(0).cast("long")
    placed = turns.withColumn("__said", said).withColumn("__at", F.coalesce(F.sum(size).over(call.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = call.orderBy("__at").rangeBetween(-(2 * chars + 1), -1)
    return placed.withColumn("context", F.right(F.concat_ws(" ", F.collect_list("__said").over(near)), F.lit(chars))).drop("__said", "__at")
