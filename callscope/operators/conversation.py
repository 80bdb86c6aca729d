"""Rules over the turns of calls; word lists and patterns come as arguments."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the finest time buckets are of 2^14 ms.
FINEST = 14


def by_call():
    return Window.partitionBy("call_id").orderBy("seq")



def _dealt(rows: DataFrame, hits: Column, *keep: str) -> DataFrame:
    """A row for each element of ``hits`` as ``p``, worked out once a row: a plain explode would do it again in a filter."""
    return rows.select(*keep, F.explode_outer(hits).alias("p")).where("p is not null")


def _said(table: Column) -> Column:
    """The entries of a literal table whose phrase stands in the text."""
    return F.filter(table, lambda p: F.lower("text").contains(p["phrase"]))


def index_turns(turns: DataFrame) -> DataFrame:
    return turns.withColumn("idx", F.row_number().over(by_call()) - 1)


def call_facts(turns: DataFrame) -> DataFrame:
    """Turns, milliseconds, speakers; ``redaction_count`` where turns carry ``n_redactions``, first and last ``emitted_at`` where they carry that."""
    more = []
    if "n_redactions" in turns.columns:
        more.append(F.coalesce(F.sum("n_redactions"), F.lit(0)).cast("long").alias("redaction_count"))
    if "emitted_at" in turns.columns:
        more += [F.min("emitted_at").alias("started_at"), F.max("emitted_at").alias("ended_at")]
    return turns.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("turn_count"), (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"), F.count_distinct("speaker").alias("speakers"), *more
    )


def render_transcripts(turns: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.col("speaker"), F.lit(": "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return index_turns(turns).groupBy("call_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def live_windows(turns: DataFrame, size: int = 6, stride: int = 2) -> DataFrame:
    """The last ``size`` turns at every ``stride``-th turn."""
    w = by_call().rowsBetween(1 - size, 0)
    out = index_turns(turns).withColumn("turns", F.collect_list("seq").over(w))
    return out.where((F.col("idx") + 1) % stride == 0).select("call_id", "idx", F.element_at("turns", 1).alias("first_seq"), F.size("turns").alias("turns"))


def score_sentiment(
    turns: DataFrame, weights: dict[str, float], negations: list[str], intensifiers: dict[str, float], window: int = 3, phrases: dict[str, float] | None = None
) -> DataFrame:
    """Mean weight of the lexicon words and ``phrases`` of a turn in [-1, 1].

    Negations flip the words after them, intensifiers raise the next; a phrase counts once, neither flipped nor raised.
    """
    weight, strong = F.from_json(F.lit(json.dumps(weights)), "map<string,double>"), F.from_json(F.lit(json.dumps(intensifiers)), "map<string,double>")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("hits"), F.lit(0).alias("i"), F.lit(-1).alias("until"), F.lit(1.0).alias("by"))

    def step(a, t):
        def state(sum_=a["sum"], hits=a["hits"], until=a["until"], by=a["by"]):
            return F.struct(sum_.alias("sum"), hits.alias("hits"), (a["i"] + 1).alias("i"), until.alias("until"), by.alias("by"))

        value = weight[t] * a["by"]
        value = F.when(a["i"] <= a["until"], value * -0.8).otherwise(value)
        plain = F.when(weight[t].isNotNull(), state(a["sum"] + value, a["hits"] + 1, by=F.lit(1.0))).otherwise(state())
        return F.when(t.isin(*negations), state(until=a["i"] + window)).when(strong[t].isNotNull(), state(by=strong[t])).otherwise(plain)

    said = F.filter(F.from_json(F.lit(json.dumps([{"p": p, "w": w} for p, w in (phrases or {}).items()])), "array<struct<p:string,w:double>>"), lambda x: F.lower("text").contains(x["p"]))
    extra = F.aggregate(said, F.lit(0.0), lambda a, x: a + x["w"]) if phrases else F.lit(0.0)
    more = F.size(said) if phrases else F.lit(0)

    def mean(a):
        hits = a["hits"] + more
        return F.when(hits == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a["sum"] + extra) / hits * 1.35)))

    score = F.aggregate(tokens, zero, step, mean)
    return turns.withColumn("sentiment", F.coalesce(score, F.lit(0.0)))


def pattern_hits(turns: DataFrame, patterns: list[tuple[str, float, str]]) -> DataFrame:
    """First match of every pattern in each non-agent turn: (call_id, seq, label, weight, start).

    The list is one literal; a text is looked through once a row for all of it, and only hits leave the row.
    """
    table = F.from_json(F.lit(json.dumps([{"pattern": p, "weight": w, "label": n} for p, w, n in patterns])), "array<struct<pattern:string,weight:double,label:string>>")
    found = F.filter(table, lambda p: F.rlike("text", p["pattern"]))
    hits = F.transform(found, lambda p: F.struct(p["label"].alias("label"), p["weight"].alias("weight"), (F.regexp_instr("text", p["pattern"]) - 1).alias("start")))
    return _dealt(turns.where("speaker != 'agent' and text is not null"), hits, "call_id", "seq").select("call_id", "seq", "p.label", "p.weight", "p.start")


def escalation_risk(turns: DataFrame, hits: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Per call: the peak pattern weight, at least that of the mood of the last three customer turns, and its band.

    A mood under -0.4 makes a risk of 0.45 and more, by as much as it is under it (0.75 at most); a good one nearly halves the risk.
    """
    peak = hits.groupBy("call_id").agg(F.max("weight").alias("peak"))
    last = sentiment.where("speaker = 'customer'").withColumn("rn", F.row_number().over(Window.partitionBy("call_id").orderBy(F.col("seq").desc()))).where("rn <= 3")
    mood = last.groupBy("call_id").agg(F.avg("sentiment").alias("mood"))
    out = turns.select("call_id").distinct().join(peak, "call_id", "left").join(mood, "call_id", "left")
    base = F.coalesce("peak", F.lit(0.0))
    upset = 0.45 + F.least(F.lit(0.3), F.abs("mood") - 0.4)
    raw = F.when(F.col("mood") < -0.4, F.greatest(base, upset)).when(F.col("mood") > 0.25, base * 0.55).otherwise(base)
    band = F.when(F.col("raw") >= 0.75, "high").when(F.col("raw") >= 0.45, "medium").when(F.col("raw") >= 0.2, "low").otherwise("none")
    return out.select("call_id", raw.alias("raw")).select("call_id", F.round(F.least("raw", F.lit(1.0)), 3).alias("risk"), band.alias("band"))


def escalated_flag(hits: DataFrame, labels: list[str]) -> DataFrame:
    """(call_id, escalated) of the calls with hits: whether one of them has a label of ``labels``."""
    return hits.groupBy("call_id").agg(F.max(F.col("label").isin(labels)).alias("escalated"))


def phrase_hits(turns: DataFrame, phrases: list[tuple[str, str]], speaker: str | None = "agent") -> DataFrame:
    """First turn of each call with each (policy, phrase): (call_id, policy_id, phrase, seq)."""
    table = F.from_json(F.lit(json.dumps([{"policy": p, "phrase": x.lower()} for p, x in phrases])), "array<struct<policy:string,phrase:string>>")
    rows = _dealt(turns.where(F.col("speaker") == speaker) if speaker else turns, _said(table), "call_id", "seq")
    return rows.groupBy("call_id", F.col("p.policy").alias("policy_id"), F.col("p.phrase").alias("phrase")).agg(F.min("seq").alias("seq"))


def disclosure_status(turns: DataFrame, required: list[tuple[str, str, int | None]]) -> DataFrame:
    """(call_id, policy_id, given, seq, anchor): whether a required phrase is said in the first n agent turns (all without n).

    ``anchor`` is the turn to cite: where the phrase is first said, or the call's first agent turn if it is missing.
    Several phrases of a policy are alternatives.
    """
    table = F.from_json(F.lit(json.dumps([{"policy": p, "phrase": x.lower(), "n": n} for p, x, n in required])), "array<struct<policy:string,phrase:string,n:int>>")
    agent = turns.where("speaker = 'agent'").withColumn("k", F.row_number().over(by_call()))
    within = _dealt(agent, F.filter(_said(table), lambda p: p["n"].isNull() | (F.col("k") <= p["n"])), "call_id", "seq")
    hits = within.groupBy("call_id", F.col("p.policy").alias("policy_id")).agg(F.min("seq").alias("seq"))
    # every call with an agent turn within a policy's window is asked for it: a call's first agent turn is
    policies = F.array_distinct(F.transform(F.filter(table, lambda p: p["n"].isNull() | (p["n"] >= 1)), lambda p: p["policy"]))
    asked = agent.groupBy("call_id").agg(F.min("seq").alias("first")).select("call_id", "first", F.explode(policies).alias("policy_id"))
    out = asked.join(hits, ["call_id", "policy_id"], "left")
    return out.select("call_id", "policy_id", F.col("seq").isNotNull().alias("given"), "seq", F.coalesce("seq", "first").alias("anchor"))


#: How much a missing disclosure weighs by the severity of its policy, and without a known one.
SEVERITY_SCORES, OTHER_SEVERITY = {"critical": 1.0, "high": 0.8, "medium": 0.55, "low": 0.3}, 0.5


def missing_disclosures(status: DataFrame, policies: DataFrame) -> DataFrame:
    """Findings (call_id, seq, policy_id, label, score) of the disclosures not given; ``policies`` are (policy_id, title, severity)."""
    score = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_SCORES.items() for x in kv])[F.coalesce("severity", F.lit("medium"))], F.lit(OTHER_SEVERITY))
    lost = status.where("not given").join(policies.select("policy_id", "title", "severity"), "policy_id")
    return lost.select("call_id", F.col("anchor").alias("seq"), "policy_id", F.col("title").alias("label"), score.alias("score"))


def score_intents(turns: DataFrame, keywords: dict[str, dict[str, float]]) -> DataFrame:
    """(call_id, intent, score): phrase weight by speaker (customer 1, others 0.45) and place (linear decay to a half)."""
    flat = [{"intent": i, "phrase": p, "w": w} for i, own in keywords.items() for p, w in own.items()]
    table = F.from_json(F.lit(json.dumps(flat)), "array<struct<intent:string,phrase:string,w:double>>")
    n = F.count(F.lit(1)).over(Window.partitionBy("call_id"))
    rows = _dealt(index_turns(turns).withColumn("n", n), _said(table), "call_id", "idx", "n", "speaker")
    share = F.when(F.col("speaker") == "customer", 1.0).otherwise(0.45)
    decay = 1.0 - 0.5 * F.col("idx") / F.greatest(F.col("n"), F.lit(1))
    return rows.groupBy("call_id", F.col("p.intent").alias("intent")).agg(F.round(F.sum(F.col("p.w") * share * decay), 6).alias("score"))


def classify_intent(turns: DataFrame, scores: DataFrame, catalog: list[str], default: str = "general_inquiry") -> DataFrame:
    """(call_id, primary_intent, secondary): the top score, and at most three with 45 % of it; ties in catalog order."""
    rank = F.array_position(F.array(*[F.lit(c) for c in catalog]), F.col("intent"))
    w = Window.partitionBy("call_id").orderBy(F.col("score").desc(), rank)
    top = F.max("score").over(Window.partitionBy("call_id"))
    s = scores.withColumn("rn", F.row_number().over(w)).withColumn("top", top).where("rn = 1 or (rn <= 4 and score >= 0.45 * top)")
    picked = s.groupBy("call_id").agg(F.max(F.when(F.col("rn") == 1, F.col("intent"))).alias("p"), F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.struct("rn", "intent")))).alias("s"))
    out = turns.select("call_id").distinct().join(picked, "call_id", "left")
    return out.select("call_id", F.coalesce("p", F.lit(default)).alias("primary_intent"), F.coalesce(F.array_join(F.transform("s", lambda x: x["intent"]), ","), F.lit("")).alias("secondary"))


def classify_resolution(turns: DataFrame, follow_up: list[str], resolved: list[str], escalated: DataFrame | None = None, up: list[str] | None = None) -> DataFrame:
    """(call_id, resolution, seq): how a call ended, and the turn that shows it.

    Calls of ``escalated`` (call_id, escalated) that are so end as ``escalated``, by their latest turn with a marker of ``up``. Of the
    others, markers in the last five turns decide, follow-up before resolved. Where no marker is found the last turn is cited.
    """
    numbered = turns.withColumn("rn", F.row_number().over(Window.partitionBy("call_id").orderBy(F.col("seq").desc())))
    any_of = lambda words: F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.lower("text").contains(w)), F.lit(False))
    at = lambda test, name: F.max(F.when(test, F.col("seq"))).alias(name)
    tail = F.col("rn") <= 5
    marks = [at(tail & any_of(follow_up), "f"), at(tail & any_of(resolved), "r"), at(any_of(up) if up else F.lit(False), "e")]
    out = numbered.groupBy("call_id").agg(F.max("seq").alias("last"), *marks)
    out = out.join(escalated.select("call_id", "escalated"), "call_id", "left") if escalated is not None else out.withColumn("escalated", F.lit(False))
    is_up = F.coalesce("escalated", F.lit(False))
    name = F.when(is_up, "escalated").when(F.col("f").isNotNull(), "follow_up_required").when(F.col("r").isNotNull(), "resolved").otherwise("unresolved")
    shown = F.when(is_up, F.col("e")).otherwise(F.coalesce("f", "r"))
    return out.select("call_id", name.alias("resolution"), F.coalesce(shown, F.col("last")).alias("seq"))


def sentiment_endpoints(scored: DataFrame) -> DataFrame:
    """Mean over the first and the last third of a call's customer turns."""
    c = scored.where("speaker = 'customer'").withColumn("k", F.row_number().over(by_call())).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("call_id")))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    c = c.withColumn("head", F.col("k") <= third).withColumn("tail", F.col("k") > F.col("n") - third)
    return c.groupBy("call_id").agg(F.round(F.avg(F.when(F.col("head"), F.col("sentiment"))), 3).alias("start"), F.round(F.avg(F.when(F.col("tail"), F.col("sentiment"))), 3).alias("end"))


def search_turns(turns: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` turns of a call by the number of the query's words that they hold; queries are (call_id, query).

    Words are postings, so a query meets only turns that share one. Turns of one number and text are one turn.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0)))
    held = turns.select("call_id", "seq", F.xxhash64("text").alias("__id"), F.explode(words("text")).alias("word")).distinct()
    asked = queries.select("call_id", "query").distinct().select("call_id", "query", F.explode(words("query")).alias("word"))
    met = asked.join(held, ["call_id", "word"]).groupBy("call_id", "query", "seq", "__id").agg(F.count(F.lit(1)).cast("int").alias("overlap"))
    w = Window.partitionBy("call_id", "query").orderBy(F.col("overlap").desc(), "seq", "__id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("call_id", "query", "seq", "overlap", "rank")


def _levelled(times: DataFrame) -> DataFrame:
    """Adds ``lo`` and ``hi``, whole numbers around a row's times, and ``level``: 2^level is longer than the row; rows without a time go."""
    rows = times.where("start_ms is not null and end_ms is not null")
    rows = rows.withColumn("lo", F.floor(F.least("start_ms", "end_ms")).cast("long")).withColumn("hi", F.ceil(F.greatest("start_ms", "end_ms")).cast("long"))
    return rows.withColumn("level", F.greatest(F.lit(FINEST), F.length(F.bin(F.col("hi") - F.col("lo")))))


def _in_buckets(rows: DataFrame, level: str) -> DataFrame:
    """A row for each time bucket of 2^level that it meets: two at most from its own level up."""
    return rows.withColumn("bucket", F.explode(F.expr(f"sequence(shiftright(lo, {level}), shiftright(hi, {level}))")))


def label_speakers(segments: DataFrame, turn_times: DataFrame) -> DataFrame:
    """Segments (call_id, seq, start_ms, end_ms) with the speaker of the timed turn (call_id, idx, ...) that holds their middle.

    Else the turn with the largest overlap, else ``unknown``; ties go to the earlier turn. A turn without a time holds nothing.
    Segment and turn meet by call and time bucket, at the level of the longer one; a pair that meets in two buckets counts once in the minimum.
    """
    s = _levelled(segments.select("call_id", "seq", "start_ms", "end_ms"))
    t = _levelled(turn_times.select("call_id", "idx", "start_ms", "end_ms", "speaker")).select("call_id", "idx", "speaker", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end"), "lo", "hi", "level")
    levels = lambda rows: F.broadcast(rows.select(F.col("level").alias("at")).distinct())  # noqa: E731  some tens of numbers at most
    own = lambda rows: _in_buckets(rows.withColumn("at", F.col("level")), "at").drop("lo", "hi", "level")
    up = lambda rows, to, test: _in_buckets(rows.join(levels(to), F.expr(test)), "at").drop("lo", "hi", "level")
    met = up(s, t, "at >= level").join(own(t), ["call_id", "at", "bucket"]).unionByName(own(s).join(up(t, s, "at > level"), ["call_id", "at", "bucket"]))
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    holds = mid.between(F.col("t_start"), F.col("t_end"))
    overlap = F.least("end_ms", "t_end") - F.greatest("start_ms", "t_start")
    best = F.min(F.struct((~holds).alias("a"), F.when(holds, 0).otherwise(-overlap).alias("b"), F.col("idx").alias("c"), F.col("speaker").alias("speaker")))
    found = met.where(holds | (overlap > 0)).groupBy("call_id", "seq").agg(best.alias("best"))
    return segments.drop("speaker").join(found, ["call_id", "seq"], "left").withColumn("speaker", F.coalesce("best.speaker", F.lit("unknown"))).drop("best")


def required_disclosures(intents: DataFrame, policies: DataFrame, always: list[str]) -> DataFrame:
    """(call_id, policy_id): the policies that always apply and those (policy_id, intents) that name an intent of the call."""
    named = intents.select("call_id", F.explode(F.array_append(F.split("secondary", ","), F.col("primary_intent"))).alias("intent"))
    scoped = policies.select("policy_id", F.explode("intents").alias("intent"))
    base = intents.select("call_id", F.explode(F.array(*map(F.lit, always)).cast("array<string>")).alias("policy_id"))
    return named.join(scoped, "intent").select("call_id", "policy_id").unionByName(base).distinct()


def action_items(turns: DataFrame, patterns: list[tuple[str, str]], noise: str, least: int = 6) -> DataFrame:
    """(call_id, seq, description, owner) of the agent's commitments by ``patterns`` (pattern, owner), once per call without case.

    A pattern's groups, joined by a blank and without blanks, dots and commas around, are the item. Items under ``least`` characters or
    that begin with ``noise`` go; turn, pattern and place decide which of equal items comes first.
    """

    def found(pattern: str, owner: str, rank: int):
        groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in range(1, re.compile(pattern).groups + 1)]
        joined = groups[0] if len(groups) == 1 else F.zip_with(groups[0], groups[1], lambda a, b: F.concat_ws(" ", a, b))
        return F.transform(joined, lambda x, i: F.struct(F.lit(rank).alias("pattern"), i.alias("place"), F.btrim(x, F.lit(" .,")).alias("item"), F.lit(owner).alias("owner")))

    items = F.concat(*[found(p, owner, k) for k, (p, owner) in enumerate(patterns)])
    rows = turns.where("speaker = 'agent' and text is not null").select("call_id", "seq", F.explode_outer(items).alias("i"))
    rows = rows.where((F.length("i.item") >= least) & ~F.col("i.item").rlike(noise))
    first = rows.groupBy("call_id", F.lower("i.item").alias("__k")).agg(F.min(F.struct("seq", "i.pattern", "i.place", "i.item", "i.owner")).alias("f"))
    return first.select("call_id", "f.seq", F.col("f.item").alias("description"), "f.owner")


def disclosure_gate(status: DataFrame, turns: DataFrame, windows: dict[str, int | None]) -> DataFrame:
    """``status`` with ``closed``: whether the agent has had more turns than the policy's window holds.

    Policies without a window, and those not listed, stay open while a call is live.
    """
    table = F.from_json(F.lit(json.dumps({p: n for p, n in windows.items() if n is not None})), "map<string,int>")
    said = turns.groupBy("call_id").agg(F.count_if(F.col("speaker") == "agent").alias("agent_turns"))
    closed = F.coalesce(F.col("agent_turns") > table[F.col("policy_id")], F.lit(False))
    return status.join(said, "call_id", "left").withColumn("closed", closed).drop("agent_turns")


def intent_evidence(turns: DataFrame, keywords: dict[str, dict[str, float]]) -> DataFrame:
    """(call_id, intent, seq, phrase, start, end) of the heaviest phrase of each intent; customer words count 1, others 0.45.

    Of equal weights the earlier turn wins, then the phrase listed first. ``start`` counts from 0.
    """
    flat = [{"intent": i, "phrase": p, "w": w, "k": k} for i, own in keywords.items() for k, (p, w) in enumerate(own.items())]
    table = F.from_json(F.lit(json.dumps(flat)), "array<struct<intent:string,phrase:string,w:double,k:int>>")
    hits = F.transform(_said(table), lambda p: F.struct(p.alias("p"), F.position(p["phrase"], F.lower("text")).alias("at")))
    rows = _dealt(turns, hits, "call_id", "seq", "speaker").select("call_id", "seq", "p.p.*", "p.at", F.when(F.col("speaker") == "customer", 1.0).otherwise(0.45).alias("share"))
    best = F.min(F.struct((-F.col("w") * F.col("share")).alias("w"), "seq", "k", "phrase", (F.col("at") - 1).alias("start")))
    out = rows.groupBy("call_id", "intent").agg(best.alias("b")).select("call_id", "intent", "b.seq", "b.phrase", "b.start")
    return out.withColumn("end", F.col("start") + F.length("phrase"))
