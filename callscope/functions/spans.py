"""Positions of regex matches as arrays of spans, in code points, without leaving the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.functions.arrays import let, running

#: The blanks that the SQL's patterns know.
BLANKS = r"\t\n\f\r "


def ascii_pattern(pattern: str) -> str:
    """A pattern for Java (and Python's ``re.ASCII``) whose ``\\b`` and ``\\s`` know ASCII only, as those of the SQL do: some Java versions take letters of all scripts for word characters.

    ``\\b`` that isn't first in an alternative must follow what ends with a word character.
    """
    out, in_class = [], False
    for token in re.findall(r"\\.|.", pattern, re.DOTALL):
        in_class = token == "[" or (in_class and token != "]")
        out.append((BLANKS if in_class else f"[{BLANKS}]") if token == r"\s" else token)
    text = re.sub(r"(^|^\(\?i\)|\|)\\b(?=\\d|\[A-Za-z0-9\]|\(\?)", r"\1(?<!\\w)", "".join(out))  # before a digit, letter or group of words
    text = re.sub(r"(?<=[^|])\\b", r"(?!\\w)", text)
    return text.replace(r"\b", r"(?:(?=\w)(?<!\w)|(?<=\w)(?!\w))")


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the non-overlapping matches, left to right.

    The gaps between matches come from ``split``, the matches from
    ``regexp_extract_all``; running lengths give the positions. Where most texts
    have no match, a plain search before it saves the second pass and the folds.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value"))), lambda p: p["value"].isNotNull())

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: p["gap"] + F.length(p["value"])), F.lit(0), lambda a, b: a + b)
        return F.zip_with(pairs, ends, lambda p, end: F.struct((end - F.length(p["value"])).alias("start"), end.alias("end"), p["value"].alias("value")))

    return let(pairs, placed)
