"""Numbers that run on from turn to turn: what of a turn is safe to show, and what is held back for the next one.

A number at the end of a turn that nothing claims yet may go on in the next
turn. Its digits are held and put in front of the call's next turn. A fragment
that the next turn doesn't complete is marked as an account; so is one that is
still held after some turns or at the end of the call. The fold carries one
short state a call over rows in order, so a call is never gathered; detection and
placeholders are the native operators on the texts that the fold gives out.

Defined results: a null text leaves the state as it is and stays null; rows of a
null call are not held; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from callscope.functions.digits import CONTEXT, NEAR, claims, read_digits
from callscope.operators import pii
from callscope.streaming.state import use_keyed_state

#: Digits of a fragment that is held, turns that it may wait, words after a number, carried characters.
SHORTEST, LONGEST, TURNS_HELD = 3, 18, 4
OPEN_WORDS, LONG_TAIL_WORDS, TAIL = 4, 12, 240
SURE = 0.9

#: Kinds whose patterns can claim a number.
_NUMERIC = {k: re.compile(pii.PATTERNS[k], re.ASCII) for k in ("ssn", "phone", "dob_numeric", "dob_wordy", "account_labelled")}
_SENTENCE_END = re.compile(r"[.!?](?:\s|$)")
_OPEN_EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]*$")

FIELDS = "part int, text string, context string, orphans array<struct<start:int,end:int>>, held_digits int"


@dataclass(frozen=True)
class Held:
    """What a call carries from turn to turn."""

    carry: str = ""
    age: int = 0
    tail: str = ""


def _claimed(text: str, context: str) -> list[tuple[int, int, float]]:
    """(start, end, confidence) of every number that some detector claims."""
    found = [(s, e, c) for _, s, e, c in claims(text, context)]
    for kind, pattern in _NUMERIC.items():
        type_, confidence, _ = pii.DETECTORS[kind]
        for m in pattern.finditer(text):
            around = f"{context} {text[max(0, m.start() - NEAR) : m.end() + NEAR]}".lower()
            near = kind in pii.SURER and any(w in around for w in CONTEXT[type_])
            if kind != "account_labelled" or sum(c.isdigit() for c in m[0]) >= 5:
                found.append((*m.span(m.lastindex or 0), pii.SURER[kind] if near else confidence))
    return found


def _release(held: int, trailing: int, expected: bool, sentence_over: bool) -> bool:
    """Whether an unclaimed number of ``held`` digits, with ``trailing`` words after it, may be shown in a final turn."""
    cases = (
        not SHORTEST <= held <= LONGEST,  # no fragment of an identifier
        trailing > LONG_TAIL_WORDS,  # the talk has moved on
        trailing > OPEN_WORDS and not expected,
        sentence_over and not expected,
    )
    return any(cases)


def hold_from(text: str, context: str, spans: list[tuple[int, int, float]], final: bool) -> int | None:
    """Where the part of a text that must wait begins; null if all of it is safe. A partial turn waits for its open email too."""
    waits = []
    if not final and (email := _OPEN_EMAIL.search(text.rstrip())):
        waits.append(email.start())
    digits, places, ends = read_digits(text)
    own = digits[ends[-1] if ends else 0 :]
    if own:
        start, end = places[len(digits) - len(own)][0], places[-1][1]
        around = f"{context} {text[max(0, start - NEAR) : end + NEAR]}".lower()
        expected = any(w in around for w in CONTEXT["IDENTIFIER"])
        after = text[end:]
        claimed = any(s <= start and end <= e and c >= SURE for s, e, c in spans)
        trailing, over = (len(after.split()), bool(_SENTENCE_END.search(after))) if final else (0, False)
        if not claimed and not _release(len(own), trailing, expected, over):
            waits.append(start)
    return min(waits, default=None)


def _orphan(fragment: str, spans: list[tuple[int, int, float]], at: int = 0) -> list[tuple[int, int]]:
    """The digits of a held fragment that stands at ``at``, unless some claim meets it."""
    digits, places, _ = read_digits(fragment)
    if len(digits) < SHORTEST or any(s < at + len(fragment) and e > at for s, e, _ in spans):
        return []
    return [(at + places[0][0], at + places[-1][1])]


def step(held: Held, text: str, final: bool = True) -> tuple[dict, Held]:
    """The row that a turn gives out, and the state after it; a partial turn leaves the state as it is."""
    whole = f"{held.carry} {text}".strip() if held.carry else text
    spans = _claimed(whole, held.tail)
    orphans = _orphan(held.carry, spans) if held.carry else []
    at = hold_from(whole, held.tail, spans + [(*o, 0.5) for o in orphans], final)
    shown, waits = (whole, "") if at is None else (whole[:at], whole[at:].strip())
    after = held
    if final:
        after = Held(waits, held.age + 1 if waits else 0, f"{held.tail} {text}"[-TAIL:])
        if after.age >= TURNS_HELD:
            begin = whole.index(waits, at)
            orphans += _orphan(waits, spans, begin)
            shown, waits, after = whole, "", replace(after, carry="", age=0)
    lead = len(shown) - len(shown.lstrip())
    shown = shown.strip()
    kept = [{"start": s - lead, "end": e - lead} for s, e in dict.fromkeys(orphans) if e - lead <= len(shown)]
    return {"part": 0, "text": shown, "context": held.tail, "orphans": kept, "held_digits": sum(c.isdigit() for c in waits)}, after


def flush(held: Held) -> dict | None:
    """The row of what is still held when the call ends."""
    if not held.carry:
        return None
    marked = [{"start": s, "end": e} for s, e in _orphan(held.carry, _claimed(held.carry, held.tail))]
    return {"part": 1, "text": held.carry, "context": held.tail, "orphans": marked, "held_digits": 0}


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    call, last, held = None, None, Held()
    names = [f.name for f in schema]
    fields = names[3:]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def shown(row: dict) -> tuple:
        return tuple(row[f] for f in fields)

    for batch in batches:
        out = []
        for own, seq, final, text in zip(*(batch.column(c).to_pylist() for c in ("call_id", "seq", "is_final", "text")), strict=True):
            if own != call:
                if rest := flush(held):
                    out.append((call, last, True, *shown(rest)))
                call, held = own, Held()
            last = seq
            if text is None:
                out.append((call, seq, final, 0, None, "", [], 0))
            else:
                given, held = step(held, text, final)
                out.append((call, seq, final, *shown(given)))
        yield made(out)
    if rest := flush(held):
        yield made([(call, last, True, *shown(rest))])


def hold_calls(turns: DataFrame) -> DataFrame:
    """(call_id, seq, is_final, part, text, context, orphans, held_digits): what each turn may show.

    ``part`` is 1 for the row that ends a call with what was still held. Turns
    without ``is_final`` are final; a partial comes before the final of its number.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    final = F.coalesce("is_final", F.lit(True)) if "is_final" in turns.columns else F.lit(True)
    all_rows = turns.select("call_id", "seq", final.alias("is_final"), "text")
    rows = all_rows.where("call_id is not null").repartition("call_id").sortWithinPartitions("call_id", "seq", "is_final")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"call_id {kinds['call_id']}, seq {kinds['seq']}, is_final boolean, {FIELDS}"
    arrow = to_arrow_schema(turns.sparkSession.createDataFrame([], schema).schema)
    loose = all_rows.where("call_id is null").selectExpr(
        "call_id", "seq", "is_final", "0 as part", "text", "'' as context", "cast(array() as array<struct<start:int,end:int>>) as orphans", "0 as held_digits"
    )
    return rows.mapInArrow(lambda batches: _fold(batches, arrow), schema).unionByName(loose)


def _detected(shown: DataFrame, kinds: list[str] | None, keys: tuple[str, ...]) -> DataFrame:
    """(keys, text, spans): the detectors with the call's tail as context, and the orphans, without overlaps."""
    text = F.col("text")
    rank = pii.PRIORITY.index("ACCOUNT")
    orphans = F.transform("orphans", lambda o: F.struct(
        F.lit(rank).alias("rank"), F.lit("ACCOUNT").alias("type"), o["start"].alias("start"), o["end"].alias("end"),
        F.lit("cross_segment").alias("detector"), F.lit(0.5).alias("confidence"), F.substring(text, o["start"] + 1, o["end"] - o["start"]).alias("value"),
    ))
    found = F.concat(pii.spans_of(text, kinds or [*pii.DETECTORS, "digit_runs"], F.col("context")), orphans)
    rows = pii.once(shown.where(text.isNotNull()), "all", found, *keys, "text").where(F.size("all") > 0)
    return pii.once(rows, "spans", pii.resolve_overlaps(F.col("all")), *keys, "text")


def redact_calls(turns: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(call_id, seq, part, text, n_redactions, redactions) of the final turns: held, joined and with placeholders numbered per call."""
    finals = turns.where(F.coalesce("is_final", F.lit(True))) if "is_final" in turns.columns else turns
    shown, keys = hold_calls(finals), ("call_id", "seq", "part")
    return pii.write_placeholders(shown, _detected(shown, kinds, keys), keys)


def preview_partials(turns: DataFrame) -> DataFrame:
    """(call_id, seq, text, held_digits) of the partial turns: any unclaimed number or unfinished email at their end is left out."""
    return hold_calls(turns).where("not is_final").select("call_id", "seq", "text", "held_digits")


#: What a match must fulfil beside its pattern, for texts that are scanned one by one.
_PATTERNS = {k: re.compile(p, 0 if k == "person_run" else re.ASCII) for k, p in pii.PATTERNS.items()}
_NOT_FIRST, _NOT_ANY = re.compile(rf"(?i)^(?:{pii.NOT_NAMES})(?:\s|$)"), re.compile(rf"(?i)(?:^|\s)(?:{pii.NOT_NAMES})(?:\s|$)")
_DOMAIN, _STREET = re.compile(pii.DOMAINS), re.compile(rf"(?i)\b(?:{pii.STREETS})\b")
_ACCEPT = {
    "spoken_email": lambda v: bool(_DOMAIN.search(v)),
    "person_trigger": lambda v: not _NOT_FIRST.search(v),
    "person_run": lambda v: not _NOT_ANY.search(v) and not _STREET.search(v),
    "account_labelled": lambda v: sum(c.isdigit() for c in v) >= 5,
}


def detect_text(text: str, context: str, orphans: list[dict] = ()) -> list[tuple[str, int, int, str, float]]:
    """(type, start, end, detector, confidence) of one text, overlaps resolved: what ``detect_pii`` finds in a table, for a stream's state."""
    found = [(t, s, e, "digit_runs", c) for t, s, e, c in claims(text, context)]
    found += [("ACCOUNT", o["start"], o["end"], "cross_segment", 0.5) for o in orphans]
    for kind, pattern in _PATTERNS.items():
        type_, confidence, _ = pii.DETECTORS[kind]
        for m in pattern.finditer(text):
            start, end = m.span(m.lastindex or 0) if kind in pii.GROUPED else m.span()
            if kind in _ACCEPT and not _ACCEPT[kind](text[start:end]):
                continue
            around = f"{context} {text[max(0, start - NEAR) : end + NEAR]}".lower()
            near = kind in pii.SURER and any(w in around for w in CONTEXT[type_])
            found.append((type_, start, end, kind, pii.SURER[kind] if near else confidence))
    kept: list[tuple[str, int, int, str, float]] = []
    for span in sorted(found, key=lambda x: (pii.PRIORITY.index(x[0]), x[1] - x[2], -x[4], x[1])):
        if all(span[2] <= o[1] or o[2] <= span[1] for o in kept):
            kept.append(span)
    return sorted(kept, key=lambda x: x[1])


def _masked(row: dict, number: Callable[[str, str], int]) -> dict:
    """The row with placeholders; ``number`` gives that of a type and value, as they first come in the call."""
    text, out, at, marks = row["text"], "", 0, []
    for type_, start, end, detector, confidence in detect_text(text, row["context"], row["orphans"]):
        value = text[start:end]
        digits = "".join(c for c in value if c in "0123456789")
        mark = f"<{type_}_{number(type_, digits if len(digits) >= 4 else value.lower())}>"
        out += text[at:start]
        marks.append({"type": type_, "placeholder": mark, "start": len(out), "end": len(out) + len(mark), "detector": detector, "confidence": confidence})
        out, at = out + mark, end
    return {"part": row["part"], "text": out + text[at:], "redactions": marks, "held_digits": row["held_digits"]}


_CONTEXT_WORDS = sorted({w for words in CONTEXT.values() for w in words})


def context_only(tail: str) -> str:
    """A tail of which only the words that rules look for near a number are left (and what may begin one at its end), each in its place."""
    low = tail.lower()
    kept = bytearray(len(low))
    for word in _CONTEXT_WORDS:
        at = low.find(word)
        while at >= 0:
            kept[at : at + len(word)] = b"\1" * len(word)
            at = low.find(word, at + 1)
        begun = next((n for n in range(min(len(word) - 1, len(low)), 0, -1) if low.endswith(word[:n])), 0)
        kept[len(low) - begun :] = b"\1" * begun
    return "".join(c if k or c == " " else "." for c, k in zip(low, kept, strict=True))


class Sealer:
    """What a state may keep of personal values: keyed hashes, and texts under a keystream that the secret and a fresh nonce give."""

    def __init__(self, secret: bytes):
        if len(secret) < 16:
            raise ValueError("the secret must have 16 bytes or more")
        self.key = hashlib.blake2b(secret).digest()

    def hashed(self, call: str, value: str) -> str:
        return hashlib.blake2b(f"{len(call)} {call}{value}".encode(), key=self.key, digest_size=16).hexdigest()

    def _stream(self, nonce: bytes, n: int) -> bytes:
        return b"".join(hashlib.blake2b(nonce + k.to_bytes(8, "big"), key=self.key).digest() for k in range(-(-n // 64)))

    def sealed(self, text: str) -> str:
        if not text:
            return ""
        nonce, data = os.urandom(16), text.encode()
        return (nonce + bytes(a ^ b for a, b in zip(data, self._stream(nonce, len(data)), strict=False))).hex()

    def opened(self, text: str) -> str:
        nonce, data = bytes.fromhex(text)[:16], bytes.fromhex(text)[16:]
        return bytes(a ^ b for a, b in zip(data, self._stream(nonce, len(data)), strict=False)).decode()


class HoldProcessor(StatefulProcessor):
    """The fold of ``hold_calls`` with typed state a call, in no clear text: what is held is sealed, of the tail only rule words are kept,
    and values that have a placeholder are keyed hashes."""

    def __init__(self, silence_ms: int, secret: bytes, names: list[str], redacted: bool):
        self.silence_ms, self.secret, self.names, self.redacted = silence_ms, secret, names, redacted

    def init(self, handle) -> None:
        self.handle, self.seal = handle, Sealer(self.secret)
        self.held = handle.getValueState("held", "carry string, age int, tail string, last long, seen long, ends long")
        self.known = handle.getMapState("known", "value string", "number int")
        self.counts = handle.getMapState("counts", "type string", "n int")

    def _number(self, call: str, type_: str, value: str) -> int:
        key = (self.seal.hashed(call, f"{type_} {value}"),)
        if self.known.containsKey(key):
            return int(self.known.getValue(key)[0])
        n = 1 + (int(self.counts.getValue((type_,))[0]) if self.counts.containsKey((type_,)) else 0)
        self.counts.updateValue((type_,), (n,))
        self.known.updateValue(key, (n,))
        return n

    def _row(self, call: str, seq: int, row: dict) -> dict:
        return {"call_id": call, "seq": seq, **(_masked(row, lambda t, v: self._number(call, t, v)) if self.redacted else row)}

    def _over(self, call: str, last: int, held: Held) -> list[dict]:
        rest = flush(held)
        out = [self._row(call, last, rest)] if rest else []
        for state in (self.held, self.known, self.counts):
            state.clear()
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        call, out = key[0], []
        carry, age, tail, last, seen, ends = self.held.get() if self.held.exists() else ("", 0, "", 0, 0, -1)
        held, over, ends = Held(self.seal.opened(carry), int(age), tail), False, int(ends)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, text, at, ended in zip(batch.seq, batch.text, batch.emitted_at, batch.ended, strict=True):
            last, seen, over = int(seq), max(int(seen), int(at.timestamp() * 1000)), over or bool(ended)
            if text is not None:
                given, held = step(held, text)
                out.append(self._row(call, last, given))
        if ends >= 0:
            self.handle.deleteTimer(ends)
        if over:
            out += self._over(call, last, held)
        else:
            ends = max(int(seen), timerValues.getCurrentWatermarkInMs()) + self.silence_ms
            self.handle.registerTimer(ends)
            self.held.update((self.seal.sealed(held.carry), held.age, context_only(held.tail), int(last), int(seen), ends))
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.held.exists():
            carry, age, tail, last, _, _ = self.held.get()
            out = self._over(key[0], int(last), Held(self.seal.opened(carry), int(age), tail))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def _stream(turns: DataFrame, secret: bytes, silence_ms: int, late: str, fields: str, redacted: bool) -> DataFrame:
    ends = F.coalesce("ended", F.lit(False)) if "ended" in turns.columns else F.lit(False)
    rows = turns.withWatermark("emitted_at", late).select(F.col("call_id").cast("string").alias("call_id"), F.col("seq").cast("long").alias("seq"), "text", "emitted_at", ends.alias("ended"))
    names = ["call_id", "seq", *(x.strip().split(" ")[0] for x in re.sub(r"<[^;]*>", "", fields).split(","))]
    use_keyed_state(turns.sparkSession)
    return rows.groupBy("call_id").transformWithStateInPandas(HoldProcessor(silence_ms, secret, names, redacted), f"call_id string, seq long, {fields}", "append", "EventTime")


def hold_stream(turns: DataFrame, secret: bytes, silence_ms: int = 25_000, late: str = "1 minute") -> DataFrame:
    """``hold_calls`` of a stream of final turns (call_id string, seq long, text, emitted_at): the state lives in Spark's store.

    A call that stays silent by event time, or whose row has ``ended`` true, gives out what it still holds. ``secret`` (16 bytes or more,
    the same after a restart) keeps what is held out of the checkpoint in clear; ``context`` has rule words only.
    """
    return _stream(turns, secret, silence_ms, late, FIELDS, False)


def redact_stream(turns: DataFrame, secret: bytes, silence_ms: int = 25_000, late: str = "1 minute") -> DataFrame:
    """(call_id, seq, part, text, redactions, held_digits) of a stream: held, joined, and with placeholders whose numbers a call keeps.

    The state of a call holds its values as hashes under ``secret``; it goes when the call ends.
    """
    return _stream(turns, secret, silence_ms, late, f"part int, text string, redactions {pii.REDACTIONS}, held_digits int", True)
