"""Findings to signals: quotes, grounding, severities, repeats; policy search and call summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Policy search ignores these words.
STOPWORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "is", "be", "must", "not", "that", "this", "it", "with", "as", "at", "by", "from"]
VIOLATION, ESCALATION, INTENT, SHIFT = "compliance_violation", "escalation_risk", "intent", "sentiment_shift"


def with_quotes(findings: DataFrame, turns: DataFrame, pad: int = 45) -> DataFrame:
    """``findings`` (call_id, seq, start, end, more) with the text around them; dots mark what is cut."""
    lo = F.greatest(F.lit(0), F.col("start") - pad)
    size = F.length("__text")
    hi = F.least(size, F.col("end") + pad)
    inner = F.regexp_replace(F.substring(F.col("__text"), lo + 1, hi - lo), r"^\s+|\s+$", "")
    quote = F.concat(F.when(lo > 0, "...").otherwise(""), inner, F.when(hi < size, "...").otherwise(""))
    return findings.join(turns.select("call_id", "seq", F.col("text").alias("__text")), ["call_id", "seq"]).withColumn("quote", quote).drop("__text")


def ground_claims(claims: DataFrame, turns: DataFrame, policies: DataFrame, longest: int = 500) -> DataFrame:
    """Claims (call_id, seq, signal_type, policy_id, more) with ``quote`` and ``reason``; a grounded claim's reason is null.

    Reasons: ``no_turn`` where the turn does not exist, ``no_policy`` where a violation names none of the catalog.
    """
    said = turns.groupBy("call_id", "seq").agg(F.coalesce(F.min("text"), F.lit("")).alias("__text"))
    known = policies.select("policy_id").distinct().withColumn("__known", F.lit(True))
    out = claims.join(said, ["call_id", "seq"], "left").join(known, "policy_id", "left")
    reason = F.when(F.col("__text").isNull(), "no_turn").when((F.col("signal_type") == VIOLATION) & F.col("__known").isNull(), "no_policy")
    return out.withColumn("quote", F.left("__text", F.lit(longest))).withColumn("reason", reason).drop("__text", "__known")


def severity(score: Column) -> Column:
    return F.when(score >= 0.95, "critical").when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def build_signals(prohibited: DataFrame, missing: DataFrame, risk: DataFrame, hits: DataFrame) -> DataFrame:
    """One table of signals: (call_id, signal_type, label, severity, confidence, policy_id, evidence as turns).

    ``prohibited`` and ``missing`` are (call_id, seq, policy_id, label, score), ``risk`` is (call_id, risk, band),
    ``hits`` (call_id, seq, label, weight). Medium and high escalation cite the first three hits; the strongest names it.
    """

    def violations(df: DataFrame, base: float, most: float) -> DataFrame:
        sure = F.round(F.least(F.lit(most), base + F.col("score") * 0.3), 3)
        return df.select("call_id", F.lit(VIOLATION).alias("signal_type"), "label", severity(F.col("score")).alias("severity"), sure.alias("confidence"), "policy_id", F.array(F.col("seq").cast("long")).alias("evidence"))

    upset = escalations(risk, hits)
    return violations(prohibited, 0.65, 0.97).unionByName(violations(missing, 0.6, 0.92)).unionByName(upset)


def gate_missing(missing: DataFrame, gate: DataFrame) -> DataFrame:
    """The findings of missing disclosures whose window is closed: ``gate`` is (call_id, policy_id, closed, more)."""
    return missing.join(gate.where("closed").select("call_id", "policy_id").distinct(), ["call_id", "policy_id"], "left_semi").select(*missing.columns)


def with_window_bounds(signals: DataFrame, turns: DataFrame, size: int = 6) -> DataFrame:
    """``signals`` with ``window_start_ms`` and ``window_end_ms``: when the last ``size`` turns of their call begin and end (0 without turns)."""
    last = turns.withColumn("__n", F.row_number().over(Window.partitionBy("call_id").orderBy(F.col("seq").desc()))).where(F.col("__n") <= size)
    bounds = last.groupBy("call_id").agg(F.max_by("start_ms", "__n").alias("window_start_ms"), F.min_by("end_ms", "__n").alias("window_end_ms"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("window_start_ms", "window_end_ms")}
    return signals.join(bounds, "call_id", "left").withColumns(zero)


def with_evidence(signals: DataFrame, turns: DataFrame, longest: int = 500) -> DataFrame:
    """``signals`` with ``quotes`` in the order of ``evidence``: (seq, speaker, quote) of the turns cited; a turn that isn't there is left out.

    A signal is told by its call, type, label and policy.
    """
    keys = ["call_id", "signal_type", "label", "policy_id"]
    cited = signals.select(*keys, F.posexplode("evidence").alias("__at", "seq")).withColumn("__policy", F.coalesce("policy_id", F.lit("")))
    said = turns.select("call_id", "seq", "speaker", F.left("text", F.lit(longest)).alias("quote"))
    quotes = cited.join(said, ["call_id", "seq"]).groupBy("call_id", "signal_type", "label", "__policy").agg(F.array_sort(F.collect_set(F.struct("__at", "seq", "speaker", "quote"))).alias("__q"))
    out = signals.withColumn("__policy", F.coalesce("policy_id", F.lit(""))).join(quotes, ["call_id", "signal_type", "label", "__policy"], "left")
    spans = F.transform("__q", lambda q: F.struct(q["seq"].alias("seq"), q["speaker"].alias("speaker"), q["quote"].alias("quote")))
    empty = F.array().cast("array<struct<seq:bigint,speaker:string,quote:string>>")
    return out.withColumn("quotes", F.coalesce(spans.cast("array<struct<seq:bigint,speaker:string,quote:string>>"), empty)).drop("__q", "__policy").select(*signals.columns, "quotes")


#: Signals of one call and pass, and by path the base, slope and most of a violation's confidence when prohibited or missing.
MOST_SIGNALS = 12
CONFIDENCE = {"fast": {"prohibited": (0.65, 0.3, 0.97), "missing": (0.6, 0.3, 0.92)}, "judged": {"prohibited": (0.6, 0.35, 0.95), "missing": (0.55, 0.35, 0.9)}}


def judge_calls(prohibited: DataFrame, missing: DataFrame, risk: DataFrame, hits: DataFrame, shifts: DataFrame, intents: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Signals of whole calls, with ``place``: violations, escalation, a shift of mood and the intent, ``MOST_SIGNALS`` a call at most.

    ``shifts`` are (call_id, label, delta, anchor), ``intents`` (call_id, intent, seq) of each call's primary intent. Violations of the
    (call_id, policy_id) of ``flagged`` were raised before and are left out.
    """

    def violations(df: DataFrame, kind: str, rank: int) -> DataFrame:
        base, slope, most = CONFIDENCE["judged"][kind]
        own = df if flagged is None else df.join(flagged.select("call_id", "policy_id").distinct(), ["call_id", "policy_id"], "left_anti")
        sure = F.round(F.least(F.lit(most), base + F.col("score") * slope), 3)
        return own.select("call_id", F.lit(VIOLATION).alias("signal_type"), "label", severity(F.col("score")).alias("severity"), sure.alias("confidence"), "policy_id", F.array(F.col("seq").cast("long")).alias("evidence"), F.lit(rank).alias("kind"))

    none = F.lit(None).cast("string").alias("policy_id")
    one = lambda c: F.array(F.col(c).cast("long")).alias("evidence")
    moved = F.abs("delta")
    parts = [
        violations(prohibited, "prohibited", 0), violations(missing, "missing", 1),
        escalations(risk, hits).withColumn("kind", F.lit(2)),
        shifts.select("call_id", F.lit(SHIFT).alias("signal_type"), "label", F.when(moved > 0.6, "medium").otherwise("low").alias("severity"), F.round(F.least(F.lit(0.9), moved), 3).alias("confidence"), none, one("anchor"), F.lit(3).alias("kind")),
        intents.select("call_id", F.lit(INTENT).alias("signal_type"), F.col("intent").alias("label"), F.lit("info").alias("severity"), F.lit(0.7).alias("confidence"), none, one("seq"), F.lit(4).alias("kind")),
    ]
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("kind", F.get("evidence", F.lit(0)), "policy_id", "label"))
    return reduce(DataFrame.unionByName, parts).withColumn("place", place).where(F.col("place") <= MOST_SIGNALS).drop("kind")


def escalations(risk: DataFrame, hits: DataFrame) -> DataFrame:
    """Medium and high risks with their hits: the first three are cited, the strongest names the signal."""
    cited = hits.groupBy("call_id").agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("seq", "label"))), 1, 3), lambda x: x["seq"].cast("long")).alias("evidence"),
        F.min(F.struct((-F.col("weight")).alias("w"), "seq", "label"))["label"].alias("label"),
    )
    upset = risk.where("band in ('medium', 'high')").join(cited, "call_id")
    return upset.select("call_id", F.lit(ESCALATION).alias("signal_type"), "label", F.col("band").alias("severity"), F.round("risk", 3).alias("confidence"), F.lit(None).cast("string").alias("policy_id"), "evidence")


def suppress_repeats(signals: DataFrame, rise: float = 0.15) -> DataFrame:
    """Signals (call_id, idx, signal_type, policy_id, label, severity, confidence, anchor) that bring news, in order of ``idx``.

    A violation passes once per call and policy, an intent when its label changes, a shift when label or anchor changes;
    anything else when label or severity differs from the last one passed, or confidence rose by ``rise`` over it.
    """
    once = (F.col("signal_type") == VIOLATION) & F.col("policy_id").isNotNull()
    by_policy = Window.partitionBy("call_id", "policy_id").orderBy("idx")
    first = signals.where(once).withColumn("__n", F.row_number().over(by_policy)).where("__n = 1").drop("__n")

    by_kind = Window.partitionBy("call_id", "signal_type").orderBy("idx")
    state = F.when(F.col("signal_type") == SHIFT, F.struct("label", F.col("anchor").cast("long").alias("anchor"))).otherwise(F.struct("label", F.lit(None).cast("long").alias("anchor")))
    moved = signals.where(F.col("signal_type").isin(INTENT, SHIFT)).withColumn("__s", state)
    moved = moved.withColumn("__p", F.lag("__s").over(by_kind)).where(F.col("__p").isNull() | ~F.col("__p").eqNullSafe(F.col("__s"))).drop("__s", "__p")

    rest = signals.where(~once & ~F.col("signal_type").isin(INTENT, SHIFT))
    names = [c for c in rest.columns if c not in ("call_id", "signal_type")]
    row = F.struct("idx", *[c for c in names if c != "idx"])
    runs = rest.groupBy("call_id", "signal_type").agg(F.array_sort(F.collect_list(row)).alias("__all"))

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        news = ~s["label"].eqNullSafe(last["label"]) | ~s["severity"].eqNullSafe(last["severity"]) | (s["confidence"] - F.round(last["confidence"], 2) >= rise)
        return F.when((F.size(kept) == 0) | news, F.concat(kept, F.array(s))).otherwise(kept)

    runs = runs.select("call_id", "signal_type", F.explode(F.aggregate("__all", F.slice("__all", 1, 0), step)).alias("s")).select("call_id", "signal_type", *[F.col(f"s.{c}") for c in names])
    return first.unionByName(moved).unionByName(runs.select(*signals.columns))


def search_policies(queries: DataFrame, policies: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` policies (policy_id, place, text) of each (query_id, query) by the share of its terms they hold; ties by place."""
    terms = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))), lambda w: ~w.isin(STOPWORDS))
    asked = queries.withColumn("__t", terms("query")).select("query_id", F.size("__t").alias("n"), F.explode("__t").alias("term"))
    held = policies.select("policy_id", "place", F.explode(terms("text")).alias("term"))
    scored = asked.join(held, "term").groupBy("query_id", "policy_id", "place", "n").agg(F.count(F.lit(1)).alias("__c"))
    scored = scored.withColumn("score", F.round(F.col("__c") / F.col("n"), 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "place"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "policy_id", "score", "rank")


def sentiment_shift(scored: DataFrame, least: float = 0.35) -> DataFrame:
    """(call_id, label, delta, anchor) of calls with three customer turns or more whose later half moved from the earlier half.

    An odd turn in the middle counts for neither half; the anchor is the most extreme later turn, the first of equals.
    """
    w = Window.partitionBy("call_id")
    c = scored.where("speaker = 'customer'").withColumn("k", F.row_number().over(w.orderBy("seq"))).withColumn("n", F.count(F.lit(1)).over(w)).where("n >= 3")
    half = F.floor(F.col("n") / 2)
    late = F.col("k") > F.col("n") - half
    out = c.groupBy("call_id").agg(
        (F.avg(F.when(late, F.col("sentiment"))) - F.avg(F.when(F.col("k") <= half, F.col("sentiment")))).alias("delta"),
        F.min(F.when(late, F.struct("sentiment", "seq")))["seq"].alias("low"),
        F.min(F.when(late, F.struct((-F.col("sentiment")).alias("s"), "seq")))["seq"].alias("high"),
    )
    worse = F.col("delta") < 0
    out = out.where(F.abs("delta") >= least)
    return out.select("call_id", F.when(worse, "negative_shift").otherwise("positive_shift").alias("label"), F.round("delta", 3).alias("delta"), F.when(worse, F.col("low")).otherwise(F.col("high")).alias("anchor"))


def summary_evidence(prohibited: DataFrame, disclosures: DataFrame, actions: DataFrame) -> DataFrame:
    """(call_id, part, name, seq): the turn that each part of a call's summary rests on.

    A violation rests on the first turn with a prohibited phrase of its policy, else on the turn to cite for the missing disclosure;
    a disclosure on the turn that gives it, an action item (by its text) on the turn of the commitment.
    """
    said = prohibited.groupBy("call_id", F.col("policy_id").alias("name")).agg(F.min("seq").alias("seq"), F.lit(0).alias("rank"))
    lost = disclosures.where("not given").select("call_id", F.col("policy_id").alias("name"), F.col("anchor").alias("seq"), F.lit(1).alias("rank"))
    broken = said.unionByName(lost).groupBy("call_id", "name").agg(F.min_by("seq", "rank").alias("seq"))
    part = lambda df, name: df.select("call_id", F.lit(name).alias("part"), "name", "seq")
    kept = disclosures.where("given").select("call_id", F.col("policy_id").alias("name"), "seq")
    done = actions.select("call_id", F.left("description", F.lit(200)).alias("name"), "seq")
    return part(broken, "violation").unionByName(part(kept, "disclosure")).unionByName(part(done, "action"))


#: Fixed value: action items of a summary.
MOST_ACTIONS = 8


def summarize_calls(
    facts: DataFrame, intents: DataFrame, resolution: DataFrame, moods: DataFrame, hits: DataFrame, prohibited: DataFrame, disclosures: DataFrame, escalating: list[str],
    actions: DataFrame | None = None, flagged: DataFrame | None = None,
) -> DataFrame:
    """One row a call: intent, resolution, moods, escalation, policies broken and kept, a sentence, action items and the turn cited.

    ``hits`` with an ``escalating`` label mark a call as escalated; a policy is broken if ``prohibited`` names it, ``flagged``
    (call_id, policy_id) did so before, or ``disclosures`` has it as not given. Of ``actions`` the first ``MOST_ACTIONS`` are listed.
    """
    up = hits.groupBy("call_id").agg(F.max(F.col("label").isin(escalating)).alias("escalated"))
    broken = prohibited.select("call_id", "policy_id").unionByName(disclosures.where("not given").select("call_id", "policy_id"))
    if flagged is not None:
        broken = broken.unionByName(flagged.select("call_id", "policy_id"))
    listed = lambda df, name: df.groupBy("call_id").agg(F.array_join(F.array_sort(F.collect_set("policy_id")), ",").alias(name))
    out = facts.select("call_id", "turn_count").join(intents, "call_id", "left").join(resolution, "call_id", "left").join(moods, "call_id", "left").join(up, "call_id", "left")
    out = out.join(listed(broken, "violations"), "call_id", "left").join(listed(disclosures.where("given"), "disclosures"), "call_id", "left")
    if actions is not None:
        item = F.struct("seq", F.left("description", F.lit(200)).alias("description"), "owner")
        first = F.row_number().over(Window.partitionBy("call_id").orderBy("seq", "description"))
        own = actions.withColumn("__n", first).where(F.col("__n") <= MOST_ACTIONS).groupBy("call_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
        out = out.join(own, "call_id", "left")
    items = F.coalesce(F.col("items") if actions is not None else F.lit(None), F.array().cast("array<struct<seq:bigint,description:string,owner:string>>")).alias("action_items")
    cited = (F.col("seq") if "seq" in out.columns else F.lit(None)).cast("long").alias("evidence")
    out = out.withColumn("escalated", F.coalesce("escalated", F.lit(False))).withColumn("resolution", F.when(F.col("escalated"), "escalated").otherwise(F.col("resolution")))
    # The sentences of a summary.
    end = (
        F.when(F.col("escalated"), " The call was escalated to a supervisor before it concluded.").when(F.col("resolution") == "resolved", " The agent resolved the issue on the call.")
        .when(F.col("resolution") == "follow_up_required", " The agent committed to follow-up action after the call.").otherwise(" The issue was not settled during the call.")
    )
    said = F.concat(F.lit("The customer called about "), F.replace(F.col("primary_intent"), F.lit("_"), F.lit(" ")), F.lit(" over "), F.col("turn_count").cast("string"), F.lit(" turns."), end)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    mood = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return out.select("call_id", "primary_intent", blank("secondary"), "resolution", mood("start", "sentiment_start"), mood("end", "sentiment_end"), "escalated", blank("violations"), blank("disclosures"), said.alias("summary"), items, cited)
