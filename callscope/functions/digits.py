"""Digits of a text, typed or spoken, with their places, and the identifiers that they make up.

The scan carries state from digit to digit, so it runs per text in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spoken digits, words that repeat the next one, and how far filler words may part a number.
UNITS = {"zero": "0", "oh": "0", "o": "0", "nought": "0", "nil": "0", "one": "1", "won": "1", "two": "2", "three": "3", "tree": "3",
         "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "ate": "8", "nine": "9"}
TEENS = {"ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16",
         "seventeen": "17", "eighteen": "18", "nineteen": "19"}
TENS = {"twenty": "2", "thirty": "3", "forty": "4", "fourty": "4", "fifty": "5", "sixty": "6", "seventy": "7", "eighty": "8", "ninety": "9"}
REPEATS = {"double": 2, "triple": 3, "treble": 3}
FILLERS, STOPS = 5, ".?!;"

#: Words near a number that tell its kind, and how near in characters.
NEAR = 70
CONTEXT = {
    "CARD": ("card", "visa", "mastercard", "master card", "amex", "american express", "discover", "credit", "debit", "cvv", "security code", "expiry", "expiration", "pan", "charge", "pay", "payment"),
    "SSN": ("social", "social security", "ssn", "s.s.n", "tax id", "taxpayer", "tin"),
    "PHONE": ("phone", "number to reach", "reach you", "call you", "mobile", "cell", "text", "contact number", "best number"),
    "DOB": ("birth", "born", "birthday", "date of birth", "dob", "d.o.b"),
    "ACCOUNT": ("account", "acct", "acc no", "reference", "member", "policy", "order", "customer number", "case number"),
    "IDENTIFIER": ("account", "acct", "acc no", "a/c", "card", "visa", "mastercard", "amex", "discover", "social", "ssn", "phone", "mobile", "cell", "reference", "policy", "member", "order", "routing",
                   "sort code", "case number", "customer number", "confirmation", "claim number"),
}

#: Fixed values, first fit wins: context, longest and shortest length, condition, confidence with and without a context word (None: no claim).
RULES = (
    ("CARD", 19, 13, "luhn", 0.99, 0.99),
    ("CARD", 16, 15, "", 0.72, None),
    ("CARD", 16, 16, "", 0.45, 0.45),
    ("SSN", 9, 9, "", 0.9, None),
    ("PHONE", 11, 11, "one", 0.9, 0.6),
    ("PHONE", 10, 10, "", 0.9, 0.6),
    ("DOB", 8, 8, "", 0.8, None),
    ("ACCOUNT", 12, 9, "", 0.85, 0.4),
    ("IDENTIFIER", 8, 5, "all", 0.5, None),
)

#: What stands between two numbers: words, and the signs that may end a number.
_BETWEEN = re.compile(r"[0-9]+|[A-Za-z']+|[^\w\s]")
_STOP = re.compile("[" + re.escape(STOPS) + "]")


def _numeric() -> re.Pattern:
    """Digits, and whole words that stand for some, in any case; the first character by itself, so that the search skips to it."""
    by_first: dict[str, list[str]] = {}
    for w in sorted([*UNITS, *TEENS, *TENS, *REPEATS], key=len, reverse=True):
        by_first.setdefault(w[0], []).append("".join(f"[{c}{c.upper()}]" for c in w[1:]))
    words = "|".join(f"(?<=[{c}{c.upper()}])(?:{'|'.join(rest)})(?![A-Za-z'])" for c, rest in by_first.items())
    return re.compile(rf"[0-9{''.join(c + c.upper() for c in by_first)}](?<![A-Za-z'][A-Za-z])(?:(?<=[0-9])[0-9]*|{words})")


_NUMERIC = _numeric()
_DOUBLED = str.maketrans("0123456789", "0246813579")


def read_digits(text: str) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The ASCII digits of a text, the place of each, and the indices before which a number must end.

    Only digits and words that stand for some are read one by one; what lies between two of them tells whether they are parted.
    """
    digits: list[str] = []
    places: list[tuple[int, int]] = []
    ends: list[int] = []
    before, times, round_ten = 0, 1, False

    for m in _NUMERIC.finditer(text):
        word, place = m.group().lower(), m.span()
        if before and place[0] > before and (next_ := _BETWEEN.search(text, before, place[0])):
            times, round_ten = 1, False
            if digits and (not ends or ends[-1] != len(digits)) and _parted(text, next_.start(), place[0]):
                ends.append(len(digits))
        before, after_ten, round_ten = place[1], round_ten, False
        if word in UNITS:
            if after_ten and UNITS[word] != "0":  # "forty two": the unit takes the zero's place
                digits[-1], places[-1] = UNITS[word], place
            else:
                digits += UNITS[word] * times
                places += [place] * times
            times = 1
        elif word.isdigit():
            digits += word
            places += [(at, at + 1) for at in range(*place)]
            times = 1
        elif word in REPEATS:
            times = REPEATS[word]
        else:
            digits += TEENS.get(word) or TENS[word] + "0"
            places += [place] * 2
            times, round_ten = 1, word in TENS
    return "".join(digits), places, [e for e in ends if e < len(digits)]


def _parted(text: str, lo: int, hi: int) -> bool:
    """Whether a sign ends a number in this stretch, or more filler words stand there than may part one."""
    if _STOP.search(text, lo, hi):
        return True
    fillers = 0
    for m in _BETWEEN.finditer(text, lo, hi):
        fillers += m.group().isalpha()
        if fillers > FILLERS:
            return True
    return False


def luhn(digits: str) -> bool:
    """Mod-10 check; from the right, every second digit is doubled and its digits are summed."""
    return len(digits) >= 12 and sum(map(int, digits[-1::-2] + digits[-2::-2].translate(_DOUBLED))) % 10 == 0


def claims(text: str | None, context: str | None = "") -> list[tuple[str, int, int, float]]:
    """(type, start, end, confidence) of the identifiers, left to right; ``context`` is carried text that counts as near.

    A null or empty text has none. Digits of a number that no rule claims join the claim
    before them (the first claim takes those in front); a widened claim has 0.9 at most.
    """
    digits, places, ends = read_digits(text or "")
    carried = (context or "").lower()
    out = []

    def near(kind: str, first: int, n: int) -> bool:
        around = carried + " " + text[max(0, places[first][0] - NEAR) : places[first + n - 1][1] + NEAR].lower()
        return any(w in around for w in CONTEXT[kind])

    def fit(at: int, end: int):
        for kind, longest, shortest, needs, sure, unsure in RULES:
            have = end - at
            lengths = [have] if needs == "all" and shortest <= have <= longest else range(min(longest, have), shortest - 1, -1) if needs != "all" else []
            for n in lengths:
                if (needs == "luhn" and not luhn(digits[at : at + n])) or (needs == "one" and digits[at] != "1"):
                    continue
                confidence = sure if sure == unsure or near(kind, at, n) else unsure
                if confidence is not None:
                    return at, n, "ACCOUNT" if kind == "IDENTIFIER" else kind, confidence
        return None

    for begin, end in zip([0, *ends], [*ends, len(digits)], strict=True):
        found, at = [], begin
        while at < end:
            hit = fit(at, end)
            at += hit[1] if hit else 1
            if hit:
                found.append(hit)
        bounds = [begin, *(f[0] for f in found[1:]), end]
        for (at, n, kind, confidence), lo, hi in zip(found, bounds, bounds[1:], strict=False):
            wide = (places[lo][0], places[hi - 1][1])
            same = wide == (places[at][0], places[at + n - 1][1])
            out.append((kind, *wide, confidence if same else min(confidence, 0.9)))
    return out


def digit_stream(text: Column) -> Column:
    """struct<digits, starts, ends, breaks> of a text; null for null."""

    @F.pandas_udf("digits string, starts array<int>, ends array<int>, breaks array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [read_digits(t or "") for t in texts]
        return pd.DataFrame({"digits": [d for d, _, _ in rows], "starts": [[s for s, _ in p] for _, p, _ in rows], "ends": [[e for _, e in p] for _, p, _ in rows], "breaks": [b for _, _, b in rows]})

    return F.when(text.isNotNull(), run(text))


def digit_claims(text: Column, context: Column | None = None) -> Column:
    """array<struct<type, start, end, confidence>> of ``claims``."""

    @F.pandas_udf("array<struct<type:string,start:int,end:int,confidence:double>>")
    def run(texts: pd.Series, carried: pd.Series) -> pd.Series:
        names = ("type", "start", "end", "confidence")
        return pd.Series([[dict(zip(names, c, strict=True)) for c in claims(t, x)] for t, x in zip(texts, carried, strict=True)])

    return run(text, F.lit("") if context is None else context)
