"""Corpus measures of redaction and evidence: leaks, span coverage, citations, action items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators.order import settled

#: Calls that may be broadcast; above them a shuffle join is used.
MAX_CALLS = 500_000
#: Shortest values that count as a leak, words of digits, share of characters that counts as covered.
LEAST_LEAK, LEAST_QUOTE, COVERED = 5, 8, 0.9
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _by_turn(df: DataFrame, column: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("seq", column)))
    return df.where(F.col(column).isNotNull()).groupBy("call_id").agg(F.array_join(F.transform(lines, lambda x: x[column]), "\n").alias("emitted"))


def _postings(turns: DataFrame, q: int) -> DataFrame:
    """(call_id, gram, pos) of every run of ``q`` digits in the string that a call's pieces (call_id, seq, s, more) make in order.

    Pieces that follow each other share a run through the last digits before a piece, which come from the pieces just before it, so a
    call's string is never put together. What isn't a digit in a piece parts runs.
    """
    order = Window.partitionBy("call_id").orderBy("seq", "s")
    own = turns.where(F.length("s") > 0).withColumn("at", F.coalesce(F.sum(F.length("s")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.right(F.concat_ws("", *[F.lag(F.right("s", F.lit(q - 1)), k).over(order) for k in range(q - 1, 0, -1)]), F.lit(q - 1))
    own = own.withColumn("__tail", before).withColumn("__t", F.concat("__tail", "s")).where(F.col("__t").rlike(f"[0-9]{{{q}}}"))
    grams = F.transform(F.sequence(F.lit(1), F.length("__t") - q + 1), lambda i: F.struct(F.substring("__t", i, F.lit(q)).alias("gram"), (F.col("at") - F.length("__tail") + i - 1).alias("pos")))
    rows = own.select("call_id", F.explode_outer(F.filter(grams, lambda g: g["gram"].rlike("^[0-9]+$"))).alias("g")).where("g is not null")
    return rows.select("call_id", "g.gram", "g.pos").distinct()


def _places(wanted: DataFrame, postings: DataFrame, q: int) -> DataFrame:
    """(call_id, digits, pos): where the strings ``wanted`` (call_id, digits; ``q`` digits or more) stand in their call.

    A string's rarest run in the call gives the candidates; the runs that cover it must all stand at their places.
    """
    n = F.length("digits")
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), n - q, F.lit(q)), F.array(n - q)))
    cover = wanted.distinct().select("call_id", "digits", F.size(offsets).alias("parts"), F.explode(offsets).alias("off"))
    cover = cover.withColumn("gram", F.substring("digits", F.col("off") + 1, F.lit(q)))
    counts = postings.join(cover.select("call_id", "gram").distinct(), ["call_id", "gram"], "left_semi").groupBy("call_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    met = cover.join(counts, ["call_id", "gram"])  # a run that the call lacks leaves its string without a part
    rarest = met.groupBy("call_id", "digits", "parts").agg(F.count(F.lit(1)).alias("__met"), F.min_by(F.struct("gram", "off"), F.struct("n", "off")).alias("k")).where("__met = parts")
    found = rarest.select("call_id", "digits", "parts", F.col("k.gram").alias("gram"), F.col("k.off").alias("at")).join(postings, ["call_id", "gram"]).select("call_id", "digits", "parts", (F.col("pos") - F.col("at")).alias("begin"))
    checked = found.join(cover.select("call_id", "digits", "off", "gram"), ["call_id", "digits"]).withColumn("pos", F.col("begin") + F.col("off")).join(postings, ["call_id", "gram", "pos"], "left_semi")
    whole = checked.groupBy("call_id", "digits", "begin", "parts").agg(F.count(F.lit(1)).alias("n")).where("n = parts")
    return whole.select("call_id", "digits", F.col("begin").alias("pos"))


def _of_calls(df: DataFrame, calls: DataFrame) -> DataFrame:
    """The rows of the calls that ``calls`` (settled) names: broadcast if they are counted to be few."""
    ids = calls.select("call_id").distinct()
    return df.join(F.broadcast(ids) if ids.limit(MAX_CALLS + 1).count() <= MAX_CALLS else ids, "call_id", "left_semi")


def _spoken(turns: DataFrame) -> DataFrame:
    """(call_id, seq, s, first, last): a character a word of the turn: its digit if it is one (else ``x``), if it ends with one, if it begins with one."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    digit = F.create_map(*[x for k, w in enumerate(DIGIT_WORDS) for x in (F.lit(w), F.lit(str(k)))])
    names = "|".join(DIGIT_WORDS)
    coded = lambda c, part: F.array_join(F.transform(c, lambda w: F.coalesce(digit[part(w)], F.lit("x"))), "")
    rows = turns.where("text is not null").select("call_id", "seq", "text", words.alias("__w"))
    return rows.select(
        "call_id", "seq", "text", coded("__w", lambda w: w).alias("s"), coded("__w", lambda w: F.regexp_extract(w, f"({names})$", 1)).alias("first"), coded("__w", lambda w: F.regexp_extract(w, f"^({names})", 1)).alias("last")
    )


def _ends(turns: DataFrame, column: str) -> DataFrame:
    """(call_id, pos, digit) of the words of ``column`` that are digits."""
    order = Window.partitionBy("call_id").orderBy("seq", "s").rowsBetween(Window.unboundedPreceding, -1)
    own = turns.where(F.length("s") > 0).withColumn("at", F.coalesce(F.sum(F.length("s")).over(order), F.lit(0))).where(F.col(column).rlike("[0-9]"))
    each = F.transform(F.split(column, ""), lambda c, i: F.struct(c.alias("digit"), (F.col("at") + i).alias("pos")))
    rows = own.select("call_id", F.explode_outer(F.filter(each, lambda x: x["digit"].rlike("[0-9]"))).alias("x")).where("x is not null")
    return rows.select("call_id", "x.digit", "x.pos")


def find_leaks(values: DataFrame, emitted: DataFrame) -> DataFrame:
    """``values`` (call_id, value, more) with ``space``: where the value shows in the call's emitted text.

    ``digits`` or ``spoken`` for values of five digits or more (punctuation does not hide them, nor does a turn's end),
    ``raw`` for emails and values without digits, else empty; values too short to tell and calls without text are empty.

    Digits and spoken digits are found through postings of digit runs, raw values through their rarest inner word or run of 5
    characters: no value is compared with a whole call, and no call is put together, but for raw values with a line break or
    under 5 characters. Only texts of calls with a value are read for it, once for numbers and once for raw values; what is found
    in them is kept (``settled``), so that no later step reads a text again.
    """
    own, raw, values = _digits(F.col("value")), F.trim("value"), settled(values)
    told = settled(values.select("call_id", "value").distinct().withColumns({"digits": own, "raw": raw}))
    long_ = told.where(F.length("digits") >= LEAST_LEAK)
    plain = told.where((F.length("digits") < LEAST_LEAK) & (F.col("value").contains("@") | ((F.col("digits") == "") & (F.length("raw") >= LEAST_LEAK))))

    heard_of = _of_calls(emitted.where("text is not null"), long_)
    said = settled(_spoken(heard_of).withColumn("typed", _digits(F.col("text"))).drop("text"))  # one pass over the texts
    postings = settled(_postings(said.select("call_id", "seq", F.col("typed").alias("s")), LEAST_LEAK))
    typed = _places(long_.select("call_id", "digits"), postings, LEAST_LEAK)
    typed = long_.join(typed.select("call_id", "digits").distinct(), ["call_id", "digits"], "left_semi").select("call_id", "value", F.lit("digits").alias("space"))

    # between its ends a spoken value is whole words; its first may end a longer word, its last begin one
    said = said.drop("typed")
    inner = long_.withColumn("inner", F.substring("digits", F.lit(2), F.length("digits") - 2))
    q = LEAST_LEAK - 2
    heard = _places(inner.select("call_id", F.col("inner").alias("digits")), settled(_postings(said, q)), q).withColumnRenamed("digits", "inner").join(inner, ["call_id", "inner"])
    heard = heard.withColumns({"first": F.left("digits", F.lit(1)), "last": F.right("digits", F.lit(1)), "end": F.col("pos") + F.length("inner")})
    begins, ends = (_ends(said, c).select("call_id", F.col("digit").alias(c), F.col("pos").alias(f"__{c}")) for c in ("first", "last"))
    heard = heard.withColumn("__first", F.col("pos") - 1).join(begins, ["call_id", "first", "__first"], "left_semi").withColumn("__last", F.col("end")).join(ends, ["call_id", "last", "__last"], "left_semi")
    heard = heard.select("call_id", "value", F.lit("spoken").alias("space")).distinct()

    odd = F.col("raw").contains("\n") | (F.length("raw") < LEAST_LEAK)
    whole = plain.where(odd).join(_by_turn(_of_calls(emitted, plain.where(odd)), "text"), "call_id").where(F.col("emitted").contains(F.col("raw")))
    some = plain.where(~odd).withColumn("__words", F.split("raw", "[^A-Za-z0-9]+"))
    words = F.filter(F.slice("__words", F.lit(2), F.greatest(F.size("__words") - 2, F.lit(0))), lambda w: w != "")
    some = some.withColumn("__words", words)
    short = F.size("__words") == 0
    keys = F.when(short, _grams(F.col("raw"), LEAST_LEAK)).otherwise(F.col("__words"))
    texts = _of_calls(emitted.where("text is not null"), some).select("call_id", "text").distinct().withColumn("__id", F.xxhash64("text"))
    runs = texts.join(some.where(short).select("call_id").distinct(), "call_id", "left_semi")
    keyed = _keyed(texts, F.split("text", "[^A-Za-z0-9]+")).unionByName(_keyed(runs, _grams(F.col("text"), LEAST_LEAK))).distinct()
    counted = _counted(some.select("call_id", "raw", F.explode(F.transform(keys, lambda k: F.xxhash64(k))).alias("__key")), keyed)
    rarest = counted.groupBy("call_id", "raw").agg(F.min_by("__key", F.struct("__n", "__key")).alias("__key"))
    near = rarest.join(keyed, ["call_id", "__key"]).select("call_id", "__id", "raw").join(texts, ["call_id", "__id"]).where(F.col("text").contains(F.col("raw")))
    shown = whole.select("call_id", "value").unionByName(some.join(near.select("call_id", "raw").distinct(), ["call_id", "raw"], "left_semi").select("call_id", "value"))

    found = typed.unionByName(heard).unionByName(shown.select("call_id", "value", F.lit("raw").alias("space")))
    best = found.groupBy("call_id", "value").agg(F.min("space").alias("space"))  # digits before spoken; raw stands alone
    return values.join(best, ["call_id", "value"], "left").withColumn("space", F.coalesce("space", F.lit(""))).select(*values.columns, "space")


def leak_rate(leaks: DataFrame, by: list[str] | None = None) -> DataFrame:
    leaked = F.count_if(F.col("space") != "")
    return leaks.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("values"), leaked.alias("leaked"), F.round(leaked / F.count(F.lit(1)), 6).alias("leak_rate"))


def span_coverage(labels: DataFrame, spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Labelled spans with ``covered``, ``type_correct`` and ``detector``.

    Covered: every digit of the label lies in some span; a label without digits needs 90 % of its characters.
    The first span that meets a covered label gives type and detector. Empty labels are not covered.
    """
    found = spans.groupBy("call_id", "seq").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", "detector"))).alias("__spans"))
    rows = labels.join(texts.select("call_id", "seq", F.col("text").alias("__text")), ["call_id", "seq"]).join(found, ["call_id", "seq"], "left")
    meets = F.filter("__spans", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]))
    rows = rows.withColumn("__spans", F.coalesce(meets, F.array().cast("array<struct<start:int,end:int,type:string,detector:string>>")))
    places = F.when(F.col("end") > F.col("start"), F.sequence("start", F.col("end") - 1))
    hit = lambda p: F.exists("__spans", lambda s: (s["start"] <= p) & (p < s["end"]))
    digits = F.filter("__places", lambda p: F.substring(F.col("__text"), p + 1, F.lit(1)).rlike("[0-9]"))
    share = F.size(F.filter("__places", hit)) / (F.col("end") - F.col("start"))
    rows = rows.withColumn("__places", places).withColumn("__digits", digits)
    covered = F.coalesce(F.when(F.size("__digits") > 0, F.forall("__digits", hit)).when(F.size("__places") > 0, share >= COVERED), F.lit(False))
    first = F.get("__spans", F.lit(0))
    rows = rows.withColumn("covered", covered)
    rows = rows.withColumn("type_correct", F.col("covered") & (first["type"] == F.col("type"))).withColumn("detector", F.when(F.col("covered"), first["detector"]))
    return rows.drop("__text", "__spans", "__places", "__digits")


def redaction_scorecard(coverage: DataFrame, by: str = "type", exempt: str = "NON_CARD") -> DataFrame:
    """Per value of ``by``: found, missed, recall and the share of found spans with the right type."""
    tp, right = F.count_if("covered"), F.count_if("type_correct")
    return coverage.where(F.col("type") != exempt).groupBy(by).agg(
        tp.alias("tp"), F.count_if(~F.col("covered")).alias("fn"), F.round(tp / F.count(F.lit(1)), 6).alias("recall"), F.round(F.try_divide(right, tp), 6).alias("type_accuracy")
    )


def redaction_report(coverage: DataFrame, spans: DataFrame, labels: DataFrame, views: tuple[str, ...] = ("type", "surface_form", "category"), exempt: str = "NON_CARD") -> DataFrame:
    """(view, name, tp, fn, fp, recall, type_accuracy): the scorecard by each of ``views``, and the covered spans by detector.

    False positives count by predicted type only. Values that are missing are ``unknown``. A view that the labels lack is left out.
    """
    rows = coverage.where(F.col("type") != exempt)
    known = [v for v in views if v in coverage.columns]
    each = F.array(*[F.struct(F.lit(v).alias("view"), F.coalesce(F.col(v).cast("string"), F.lit("unknown")).alias("name")) for v in (*known, "detector")])
    seen = rows.select("covered", "type_correct", F.explode(each).alias("x")).where("x.view != 'detector' or covered")
    cards = seen.groupBy("x.view", "x.name").agg(F.count_if("covered").alias("tp"), F.count_if(~F.col("covered")).alias("fn"), F.count_if("type_correct").alias("__right"))
    wrong = false_positives(spans, labels, exempt).select(F.lit("type").alias("view"), F.col("type").alias("name"), F.col("false_positives").alias("fp"))
    out = cards.join(wrong, ["view", "name"], "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tp", "fn", "fp", "__right")}
    out = out.withColumns(zero)
    return out.select("view", "name", "tp", "fn", "fp", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(F.try_divide(F.col("__right"), F.col("tp")), 6).alias("type_accuracy"))


def false_positives(spans: DataFrame, labels: DataFrame, exempt: str = "NON_CARD") -> DataFrame:
    """Per predicted type the spans that meet no labelled personal data.

    A sweep over each text: with labels at their starts and spans at their ends, the furthest end of the labels so far tells
    whether one reaches into the span. No span is compared with every label.
    """
    cut = spans.select("call_id", "seq", F.col("end").alias("__at"), F.lit(0).alias("__kind"), "type", F.col("start").alias("__from"), F.lit(None).cast("long").alias("__to"))
    own = labels.where(F.col("type") != exempt).select("call_id", "seq", F.col("start").alias("__at"), F.lit(1).alias("__kind"), "type", F.lit(None).cast("int").alias("__from"), F.col("end").cast("long").alias("__to"))
    so_far = Window.partitionBy("call_id", "seq").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = cut.unionByName(own).withColumn("__reach", F.max("__to").over(so_far))
    alone = swept.where((F.col("__kind") == 0) & ~F.coalesce(F.col("__reach") > F.col("__from"), F.lit(False)))
    return alone.groupBy("type").agg(F.count(F.lit(1)).alias("false_positives"))


def normalise(c: Column) -> Column:
    """Lower case, without marks at the ends and with single spaces, as the SQL's patterns read: an end is the text's own (not that before a last line break), blanks are ASCII."""
    bare = F.regexp_replace(F.lower(c), r"^[ .,!?…]+|[ .,!?…]+\z", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")


def _grams(c: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text, none of a shorter one."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _keyed(texts: DataFrame, keys: Column) -> DataFrame:
    """(call_id, __key, __id) of each key of each text, hashed: what meets by it is compared as text afterwards."""
    hashed = F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))
    return texts.select("call_id", "__id", F.explode_outer(hashed).alias("__key")).where("__key is not null")  # a plain explode works out its array again in a filter


def _counted(wanted: DataFrame, keyed: DataFrame) -> DataFrame:
    """``wanted`` (call_id, __key, ...) with ``__n``, the number of the call's texts that have the key."""
    n = keyed.join(wanted.select("call_id", "__key").distinct(), ["call_id", "__key"], "left_semi").groupBy("call_id", "__key").agg(F.count(F.lit(1)).alias("__n"))
    return wanted.join(n, ["call_id", "__key"], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))


def citation_validity(evidence: DataFrame, turns: DataFrame) -> DataFrame:
    """``evidence`` (id, call_id, quote) with ``valid``: the quote, without case, ellipses and spacing, stands in a turn of its call; under 8 characters it passes.

    A quote is compared with the distinct turns of its call that hold its rarest whole word (all but its first and last);
    one without such a word with those that hold its rarest run of 8 characters.
    """
    quotes = evidence.withColumn("__q", normalise(F.replace(F.col("quote"), F.lit("..."), F.lit(" "))))
    wanted = quotes.where(F.length("__q") >= LEAST_QUOTE).select("call_id", "__q").distinct().withColumn("__words", F.split("__q", " "))
    short = F.size("__words") <= 2
    keys = F.when(short, _grams(F.col("__q"), LEAST_QUOTE)).otherwise(F.slice("__words", F.lit(2), F.greatest(F.size("__words") - 2, F.lit(0))))
    said = turns.select("call_id", normalise(F.col("text")).alias("__t")).where("__t is not null").distinct().withColumn("__id", F.xxhash64("__t"))
    runs = said.join(wanted.where(short).select("call_id").distinct(), "call_id", "left_semi")
    keyed = _keyed(said, F.split("__t", " ")).unionByName(_keyed(runs, _grams(F.col("__t"), LEAST_QUOTE))).distinct()
    counted = _counted(wanted.select("call_id", "__q", F.explode(F.transform(keys, lambda k: F.xxhash64(k))).alias("__key")), keyed)
    rarest = counted.groupBy("call_id", "__q").agg(F.min_by("__key", F.struct("__n", "__key")).alias("__key"))
    near = rarest.join(keyed, ["call_id", "__key"]).select("call_id", "__id", "__q").join(said, ["call_id", "__id"]).where(F.col("__t").contains(F.col("__q")))
    stands = quotes.select("id", "call_id", "__q").join(near.select("call_id", "__q").distinct(), ["call_id", "__q"]).select("id").distinct().withColumn("__found", F.lit(True))
    out = quotes.join(stands, "id", "left")
    return out.withColumn("valid", F.coalesce(F.col("__found") | (F.length("__q") < LEAST_QUOTE), F.length("__q") < LEAST_QUOTE, F.lit(False))).drop("__q", "__found")


def evidence_rate(signals: DataFrame, by: list[str] | None = None) -> DataFrame:
    has = F.coalesce(F.size("evidence") > 0, F.lit(False))
    return signals.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), F.count_if(~has).alias("without_evidence"), F.round(F.avg(has.cast("double")), 4).alias("evidence_rate"))


def grounded_actions(summaries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, actions, grounded, grounded_share) of the action items of summaries: those that cite evidence."""
    items = summaries.select(*(by or []), F.explode("action_items").alias("i"))
    has = F.coalesce(F.size("i.evidence") > 0, F.lit(False))
    return items.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("actions"), F.count_if(has).alias("grounded"), F.round(F.avg(has.cast("double")), 6).alias("grounded_share"))


def action_recall(labelled: DataFrame, produced: DataFrame) -> DataFrame:
    """(call_id, items, found, recall): a labelled (id, call_id, item) is found if half of its words of over four letters stand in one produced (call_id, description).

    Of n words of which k must stand, one of any n - k + 1 does: an item is compared with the distinct descriptions of its call
    that hold the rarest run of 5 characters of one of its n - k + 1 rarest words.
    """
    words = labelled.withColumn("__w", F.filter(F.split(normalise(F.col("item")), " "), lambda w: F.length(w) > 4))
    wanted = words.where(F.size("__w") > 0).select("call_id", "__w").distinct()
    need = F.greatest(F.lit(1), F.floor(F.size("__w") / 2))
    said = produced.select("call_id", normalise(F.col("description")).alias("__p")).where("__p is not null").distinct().withColumn("__id", F.xxhash64("__p"))
    tokens = said.select("call_id", "__id", F.explode_outer(F.array_distinct(F.split("__p", " "))).alias("token")).where(F.length("token") >= 5)
    keyed = _keyed(tokens, _grams(F.col("token"), 5)).distinct()
    each = wanted.select("call_id", "__w", F.posexplode("__w").alias("__at", "word")).select("call_id", "__w", "__at", F.explode(F.transform(_grams(F.col("word"), 5), lambda g: F.xxhash64(g))).alias("__key"))
    rarest = _counted(each, keyed).groupBy("call_id", "__w", "__at").agg(F.min(F.struct("__n", "__key")).alias("k"))
    first = rarest.groupBy("call_id", "__w").agg(F.array_sort(F.collect_list(F.struct("k", "__at"))).alias("ks"))
    first = first.select("call_id", "__w", F.explode(F.array_distinct(F.transform(F.slice("ks", F.lit(1), (F.size("__w") - need + 1).cast("int")), lambda x: x["k"]["__key"]))).alias("__key"))
    near = first.join(keyed, ["call_id", "__key"]).select("call_id", "__id", "__w").distinct().join(said, ["call_id", "__id"])
    shared = F.size(F.filter("__w", lambda w: F.col("__p").contains(w)))
    met = near.where(shared >= need).select("call_id", "__w").distinct()
    found = words.select("id", "call_id", "__w").join(met, ["call_id", "__w"]).select("id").distinct().withColumn("__found", F.lit(True))
    n, hits = F.count(F.lit(1)), F.count("__found")
    return labelled.join(found, "id", "left").groupBy("call_id").agg(n.alias("items"), hits.alias("found"), F.round(hits / n, 6).alias("recall"))
