"""Live signals of running calls: native rules find what a turn says, a typed state a call decides what is news."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from callscope import rules
from callscope.operators import conversation
from callscope.operators.conversation import OTHER_SEVERITY, SEVERITY_SCORES
from callscope.operators.signals import ESCALATION, INTENT, SHIFT, VIOLATION
from callscope.streaming.state import use_keyed_state

#: Turns of a window, turns from one analysis to the next, findings that are cited, the rise that is news, the least
#: confidence of a signal, the least move of mood, and an intent's confidence and fallback.
WINDOW, STRIDE, CITED, RISE, LEAST, MOVE, INTENT_SURE, NO_INTENT = 6, 2, 3, 0.15, 0.35, 0.35, 0.7, "general_inquiry"
SIGNAL = (
    "signal_id string, call_id string, seq long, signal_type string, label string, severity string, confidence double, policy_id string, "
    "evidence array<long>, window_start_ms long, window_end_ms long"
)


def turn_features(turns: DataFrame, patterns: list[tuple[str, float, str]], phrases: list[tuple[str, str, str]], intents: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(call_id, seq, speaker, emitted_at, start_ms, end_ms, mood, hits, said, themes): what a turn says by itself, in native expressions.

    ``phrases`` are (policy_id, severity, phrase): prohibited in agent turns, or those that a disclosure needs. Themes are the phrases
    of ``intents``, weighed by speaker. Times that turns lack are 0.
    """
    scored = conversation.score_sentiment(turns, rules.MOOD_WORDS, rules.NEGATIONS, rules.INTENSIFIERS, 3, rules.MOOD_PHRASES)
    table = lambda rows, fields: F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")
    known = table([{"pattern": p, "weight": w, "label": n} for p, w, n in patterns], "pattern:string,weight:double,label:string")
    listed = table([{"policy": p, "severity": s, "phrase": x.lower()} for p, s, x in phrases], "policy:string,severity:string,phrase:string")
    hits = F.transform(F.filter(known, lambda p: F.rlike("text", p["pattern"])), lambda p: F.struct(p["label"].alias("label"), p["weight"].alias("weight")))
    said = F.filter(listed, lambda p: F.lower("text").contains(p["phrase"]))
    flat = [{"intent": i, "w": w, "phrase": p} for i, own in (intents or {}).items() for p, w in own.items()]
    share = F.when(F.col("speaker") == "customer", 1.0).otherwise(0.45)
    themes = F.filter(table(flat, "intent:string,w:double,phrase:string"), lambda x: F.lower("text").contains(x["phrase"]))
    themes = F.transform(themes, lambda x: F.struct(x["intent"].alias("intent"), (x["w"] * share).alias("w")))
    at = lambda c: (F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in turns.columns else F.lit(0).cast("long")).alias(c)
    is_agent = F.col("speaker") == "agent"
    none = lambda value: F.slice(value, 1, 0)
    return scored.where("text is not null").select(
        F.col("call_id").cast("string").alias("call_id"), F.col("seq").cast("long").alias("seq"), "speaker", "emitted_at", at("start_ms"), at("end_ms"), F.col("sentiment").alias("mood"),
        F.to_json(F.when(is_agent, none(hits)).otherwise(hits)).alias("hits"), F.to_json(F.when(is_agent, said).otherwise(none(said))).alias("said"), F.to_json(themes).alias("themes"),
    )


def _severity(score: float) -> str:
    return next((name for least, name in ((0.95, "critical"), (0.75, "high"), (0.5, "medium")) if score >= least), "low")


def _violation(policy: str, label: str, severity: str | None, seq: int, base: float, most: float) -> dict:
    score = SEVERITY_SCORES.get(severity or "medium", OTHER_SEVERITY)
    sure = round(min(most, base + score * 0.3), 3)
    return {"signal_type": VIOLATION, "label": label, "severity": _severity(score), "confidence": sure, "policy_id": policy, "evidence": [seq]}


def _risk(window: list[dict]) -> dict | None:
    hits = [(h["weight"], h["label"], t["seq"]) for t in window for h in t["hits"]]
    if not hits:
        return None
    risk = max(w for w, _, _ in hits)
    moods = [t["mood"] for t in window if t["speaker"] == "customer"][-3:]
    mood = sum(moods) / len(moods) if moods else 0.0
    risk = max(risk, 0.45 + min(0.3, -mood - 0.4)) if mood < -0.4 else risk * 0.55 if mood > 0.25 else risk
    if risk < 0.45:
        return None
    label = max(hits, key=lambda h: h[0])[1]
    band = "high" if risk >= 0.75 else "medium"
    return {"signal_type": ESCALATION, "label": label, "severity": band, "confidence": round(min(risk, 1.0), 3), "policy_id": None, "evidence": [s for _, _, s in hits[:CITED]]}


class LiveProcessor(StatefulProcessor):
    """What a call must remember between batches, each kind in a state of its own.

    ``call``: turns heard, agent turns, the first of them, customer turns, the latest event time, the timer. ``window``: the last turns'
    findings. ``seen``: numbers of turns that were heard. ``given``: disclosures made. ``passed``: the last signal passed on, by type (and
    policy). ``themes``: by intent, the sums that its score needs (the place of a turn weighs by the turns so far) and its best turn.
    ``moods``: by customer turn, the sum of moods up to it, and its own.
    """

    def __init__(self, prohibited: set[str], required: list[tuple], catalog: list[str], silence_ms: int, names: list[str]):
        self.prohibited, self.required, self.catalog, self.silence_ms, self.names = prohibited, required, catalog, silence_ms, names
        self.needed = {(p, x.lower()): n for p, _, _, x, n in required}

    def init(self, handle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", "heard long, agent long, first long, customers long, latest long, ends long")
        self.window = handle.getListState("window", "seq long, speaker string, mood double, start_ms long, end_ms long, hits string, said string")
        self.seen = handle.getMapState("seen", "seq long", "heard long")
        self.given = handle.getMapState("given", "policy string", "seq long")
        self.passed = handle.getMapState("passed", "kind string", "label string, severity string, confidence double, anchor long")
        self.themes = handle.getMapState("themes", "intent string", "total double, placed double, best double, seq long")
        self.moods = handle.getMapState("moods", "k long", "upto double, mood double, seq long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Policies that were flagged before the stream began."""
        for policy in initialState.policy_id:
            self.passed.updateValue((f"{VIOLATION} {policy}",), ("", "", 1.0, -1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        heard, agent, first, customers, latest, ends = map(int, self.call.get() if self.call.exists() else (0, 0, -1, 0, 0, -1))
        window = [tuple(t) for t in self.window.get()] if self.window.exists() else []
        out = []
        for t in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            seq = int(t.seq)
            if self.seen.containsKey((seq,)):
                continue  # the turn was delivered again
            self.seen.updateValue((seq,), (heard,))
            latest = max(latest, int(t.emitted_at.timestamp() * 1000))
            window = [*window, (seq, t.speaker, float(t.mood), int(t.start_ms), int(t.end_ms), t.hits, t.said)][-WINDOW:]
            for theme in json.loads(t.themes):
                self._theme(theme["intent"], theme["w"], heard, seq)
            heard += 1
            if t.speaker == "agent":
                agent += 1
                first = seq if first < 0 else first
                for p in json.loads(t.said):
                    n = self.needed.get((p["policy"], p["phrase"]), 0)
                    if n is None or agent <= n:
                        self.given.updateValue((p["policy"],), (seq,))
            elif t.speaker == "customer":
                before = float(self.moods.getValue((customers - 1,))[0]) if customers else 0.0
                self.moods.updateValue((customers,), (before + float(t.mood), float(t.mood), seq))
                customers += 1
            if heard % STRIDE == 0:
                out += self._news(key[0], seq, [_turn(x) for x in window], heard, agent, first, customers)
        if ends >= 0:
            self.handle.deleteTimer(ends)
        ends = max(latest, timerValues.getCurrentWatermarkInMs()) + self.silence_ms
        self.handle.registerTimer(ends)
        self.call.update((heard, agent, first, customers, latest, ends))
        self.window.put(window)
        yield pd.DataFrame(out, columns=self.names)

    def _theme(self, intent: str, weight: float, place: int, seq: int) -> None:
        total, placed, best, at = self.themes.getValue((intent,)) if self.themes.containsKey((intent,)) else (0.0, 0.0, -1.0, -1)
        if weight > best:
            best, at = weight, seq
        self.themes.updateValue((intent,), (float(total) + weight, float(placed) + weight * place, float(best), int(at)))

    def _intent(self, heard: int) -> dict | None:
        """The intent of the turns so far, as ``classify_intent`` has it, cited by its heaviest phrase; none without a phrase."""
        scores = {str(k[0]): v for k, v in self.themes.iterator()}
        rank = {name: i for i, name in enumerate(self.catalog)}
        if not scores:
            return None
        score = {k: round(float(v[0]) - 0.5 * float(v[1]) / max(1, heard), 6) for k, v in scores.items()}
        label = min(score, key=lambda k: (-score[k], rank.get(k, len(rank)), k))
        return {"signal_type": INTENT, "label": label, "severity": "info", "confidence": INTENT_SURE, "policy_id": None, "evidence": [int(scores[label][3])]}

    def _shift(self, customers: int) -> dict | None:
        """A move of the customer's mood from the earlier to the later half, anchored at the most extreme later turn."""
        if customers < 3:
            return None
        half = customers // 2
        upto = lambda k: float(self.moods.getValue((k - 1,))[0]) if k else 0.0
        delta = (upto(customers) - upto(customers - half)) / half - upto(half) / half
        if abs(delta) < MOVE:
            return None
        later = [self.moods.getValue((k,)) for k in range(customers - half, customers)]
        sign = 1 if delta < 0 else -1
        anchor = min(later, key=lambda m: sign * float(m[1]))
        label, severity = "negative_shift" if delta < 0 else "positive_shift", "medium" if abs(delta) > 0.6 else "low"
        return {"signal_type": SHIFT, "label": label, "severity": severity, "confidence": round(min(0.9, abs(delta)), 3), "policy_id": None, "evidence": [int(anchor[2])]}

    def _news(self, call: str, seq: int, window: list[dict], heard: int, agent: int, first: int, customers: int) -> list[dict]:
        found = [_violation(p["policy"], p["phrase"], p["severity"], t["seq"], 0.65, 0.97) for t in window for p in t["said"] if p["policy"] in self.prohibited]
        for policy, title, severity, _, n in self.required:
            if n is not None and agent > n and not self.given.containsKey((policy,)):
                found.append(_violation(policy, title, severity, first, 0.6, 0.92))
        found += filter(None, (_risk(window), self._shift(customers), self._intent(heard)))
        news = []
        for signal in found:
            if signal["confidence"] < LEAST:
                continue
            kind = signal["signal_type"] + (f" {signal['policy_id']}" if signal["signal_type"] == VIOLATION else "")
            anchor = signal["evidence"][0]
            last = self.passed.getValue((kind,)) if self.passed.containsKey((kind,)) else None
            if last is None or _is_news(signal, anchor, last):
                self.passed.updateValue((kind,), (signal["label"], signal["severity"], float(signal["confidence"]), int(anchor)))
                name = hashlib.sha256("\x1f".join(map(str, (call, seq, kind, signal["label"]))).encode()).hexdigest()[:16]
                news.append({"signal_id": f"sig-{name}", "call_id": call, "seq": seq, **signal, "window_start_ms": window[0]["start_ms"], "window_end_ms": window[-1]["end_ms"]})
        return news

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.call, self.window, self.seen, self.given, self.passed, self.themes, self.moods):
            state.clear()
        yield pd.DataFrame([], columns=self.names)

    def close(self) -> None:
        pass


def _turn(row: tuple) -> dict:
    seq, speaker, mood, start, end, hits, said = row
    return {"seq": int(seq), "speaker": speaker, "mood": float(mood), "start_ms": int(start), "end_ms": int(end), "hits": json.loads(hits), "said": json.loads(said)}


def _is_news(signal: dict, anchor: int, last: tuple) -> bool:
    """Whether a signal differs from the last one passed on: violations never, an intent by label, a shift by label or place."""
    label, severity, confidence, before = last
    if signal["signal_type"] == VIOLATION:
        return False
    if signal["signal_type"] == INTENT:
        return signal["label"] != label
    if signal["signal_type"] == SHIFT:
        return signal["label"] != label or anchor != int(before)
    return [signal["label"], signal["severity"]] != [label, severity] or signal["confidence"] - round(float(confidence), 2) >= RISE


def live_signals_stream(
    turns: DataFrame, prohibited: list[tuple[str, str, str]], required: list[tuple[str, str, str, str, int | None]] = (), patterns=None,
    intents: dict[str, dict[str, float]] | None = None, flagged: DataFrame | None = None, silence_ms: int = 600_000, late: str = "1 minute",
) -> DataFrame:
    """``SIGNAL`` rows of a stream of final turns (call_id, seq, speaker, text, emitted_at, and start_ms, end_ms if there): every second turn,
    the last six are judged, and the intent and the customer's mood over the call so far.

    ``prohibited`` are (policy_id, severity, phrase), ``required`` (policy_id, title, severity, phrase, agent turns). ``intents`` (without
    them, no intent is passed on) are phrase weights. Policies of ``flagged`` (call_id, policy_id), a batch, aren't passed on again. A
    number that was heard already is ignored. A call's state goes after ``silence_ms`` of event time. Turns that come late by more than
    ``late`` are dropped by the watermark, as the stream's progress reports. A signal's id follows from its call, turn, kind and label,
    so a batch that is repeated gives the same ids.
    """
    phrases = [*prohibited, *((p, s, x) for p, _, s, x, _ in required)]
    rows = turn_features(turns.withWatermark("emitted_at", late), rules.ESCALATION if patterns is None else patterns, phrases, intents)
    names = [c.strip().split(" ")[0] for c in SIGNAL.split(", ")]
    processor = LiveProcessor({p for p, _, _ in prohibited}, list(required), list(intents or {}), silence_ms, names)
    before = None if flagged is None else flagged.select(F.col("call_id").cast("string").alias("call_id"), F.col("policy_id").cast("string").alias("policy_id")).groupBy("call_id")
    use_keyed_state(turns.sparkSession)
    return rows.groupBy("call_id").transformWithStateInPandas(processor, SIGNAL, "append", "EventTime", before)
