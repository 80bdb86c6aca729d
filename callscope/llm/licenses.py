"""License scans with template markup.

Templates mark regions that may be missing or be replaced; all other wording is
mandatory. They are compiled together into one automaton over words: optional
regions are skipped by empty moves, a replaceable region reads a bounded number
of any words or one of several wordings. Its states are determinised as texts
ask for them. From each word that can begin a template the automaton reads on
until it fails; each template that it accepts on the way stands there. So a
text is accepted only where all mandatory words stand in order, with nothing
between them but what the markup allows.

A place costs at most as many steps as the longest template has words, so a text
costs time in proportion to its length. The automaton is a few hundred states
and rides with the task; texts aren't shuffled.

Score: m / (m + 4), where m is how many mandatory words the wordiest template
has that stands in the text (0 where none does): a full text weighs more than a
short notice.

Defined results: null and empty texts have no words and no places; repeated rows
are scanned one by one; of one template the longest match from a word counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import slices, utf8
from callscope.llm.decontaminate import fold_words

_MARK = re.compile(r"<<(.*?)>>", re.DOTALL)
_WORDS = re.compile(r'words="(\d+),(\d+)"')
_ANY = re.compile(r'any="(.*)"', re.DOTALL)
#: Determinised states that are kept until the table starts afresh.
MAX_STATES = 50_000


def parse(template: str) -> list:
    """Nodes of a template: a word, (lo, hi) any words, a list of wordings, or {"optional": nodes}."""
    stack: list[list] = [[]]
    for k, part in enumerate(_MARK.split(template)):
        if k % 2 == 0:
            stack[-1] += fold_words(part.encode())
        elif part.startswith("beginOptional"):
            stack.append([])
        elif part.startswith("endOptional"):
            nodes = stack.pop()
            if not stack:
                raise ValueError(f"endOptional without beginOptional: {template[:80]}")
            stack[-1].append({"optional": nodes})
        elif found := _WORDS.search(part):
            stack[-1].append((int(found[1]), int(found[2])))
        elif found := _ANY.search(part):
            stack[-1].append([fold_words(x.encode()) for x in found[1].split("|")])
        else:
            raise ValueError(f"unknown markup: {part}")
    if len(stack) > 1:
        raise ValueError(f"beginOptional without endOptional: {template[:80]}")
    return stack[0]


def mandatory(nodes: list) -> int:
    """How many words stand in every text that the nodes accept: fixed words, and the shortest of replaceable wordings."""
    return sum(1 if isinstance(x, bytes) else x[0] if isinstance(x, tuple) else min(map(len, x)) if isinstance(x, list) else 0 for x in nodes)


class TokenAutomaton:
    """One automaton of many templates, determinised as words are read."""

    def __init__(self, templates: Iterable[str]):
        self.word_moves: list[dict[bytes, set[int]]] = [{}]
        self.any_moves: list[set[int]] = [set()]
        self.empty_moves: list[set[int]] = [set()]
        self.accepts: dict[int, int] = {}
        for number, template in enumerate(templates):
            begin = self._state()
            self.empty_moves[0].add(begin)
            end = self._chain(parse(template), begin)
            self.accepts[end] = number
        first = self._closed({0})
        if any(self.any_moves[s] or s in self.accepts for s in first):
            raise ValueError("a template must begin with a word that isn't any word")
        self.alphabet = {w for moves in self.word_moves for w in moves}
        self.begins = {w for s in first for w in self.word_moves[s]}
        self._start = first
        self._reset()

    def _state(self) -> int:
        self.word_moves.append({})
        self.any_moves.append(set())
        self.empty_moves.append(set())
        return len(self.word_moves) - 1

    def _chain(self, nodes: list, at: int) -> int:
        for node in nodes:
            if isinstance(node, bytes):
                to = self._state()
                self.word_moves[at].setdefault(node, set()).add(to)
            elif isinstance(node, tuple):
                to, here = self._state(), at
                for k in range(node[1] + 1):
                    if k >= node[0]:
                        self.empty_moves[here].add(to)
                    if k < node[1]:
                        further = self._state()
                        self.any_moves[here].add(further)
                        here = further
            else:
                to = self._state()
                for wording in node if isinstance(node, list) else [node["optional"], []]:
                    self.empty_moves[self._chain(wording, at)].add(to)
            at = to
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            new = self.empty_moves[todo.pop()] - found
            found |= new
            todo += new
        return frozenset(found)

    def _reset(self) -> None:
        self._numbers: dict[frozenset[int], int] = {}
        self._sets: list[frozenset[int]] = []
        self._next: list[dict[bytes | None, int]] = []
        self._ends: list[tuple[int, ...]] = []
        self._number(self._start)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self._numbers:
            self._numbers[states] = len(self._sets)
            self._sets.append(states)
            self._next.append({})
            self._ends.append(tuple(sorted(self.accepts[s] for s in states if s in self.accepts)))
        return self._numbers[states]

    def _move(self, state: int, word: bytes | None) -> int:
        """The state after a word (None: one that no template names); -1 if none is left."""
        to: set[int] = set()
        for s in self._sets[state]:
            to |= self.any_moves[s] | self.word_moves[s].get(word, set())
        self._next[state][word] = found = self._number(self._closed(to)) if to else -1
        return found

    def scan(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, past the last) of all places, the longest of each template and first word."""
        if len(self._sets) > MAX_STATES:
            self._reset()
        begins, alphabet, found = self.begins, self.alphabet, []
        for start in [i for i, w in enumerate(words) if w in begins]:
            state, longest = 0, {}
            for at in range(start, len(words)):
                word = words[at] if words[at] in alphabet else None
                state = self._next[state][word] if word in self._next[state] else self._move(state, word)
                if state < 0:
                    break
                for template in self._ends[state]:
                    longest[template] = at + 1
            found += [(template, start, end) for template, end in longest.items()]
        return found


def scan_licenses(docs: DataFrame, templates: dict[str, Iterable[str]], phrases: dict[str, str]) -> DataFrame:
    """(doc_id, n_words, places): where templates and phrases (by label) stand, as words of the text from 0.

    A place is (label, is_phrase, first, past, mandatory); ``past`` is the word behind it.
    """
    listed = [(label, False, t) for label, own in templates.items() for t in own] + [(label, True, p) for label, p in phrases.items()]
    facts = [(label, is_phrase, mandatory(parse(t))) for label, is_phrase, t in listed]
    place = pa.struct([("label", pa.string()), ("is_phrase", pa.bool_()), ("first", pa.int64()), ("past", pa.int64()), ("mandatory", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = TokenAutomaton(t for _, _, t in listed)
        for batch in slices(batches):
            sizes, places = [], []
            for text in batch.column("text"):
                words = fold_words(text.as_py())
                sizes.append(len(words))
                places.append([dict(zip(("label", "is_phrase", "first", "past", "mandatory"), (*facts[t][:2], a, b, facts[t][2]), strict=True)) for t, a, b in machine.scan(words)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(place))], ["doc_id", "n_words", "places"])

    rows = docs.select("doc_id", utf8())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, places array<struct<label:string,is_phrase:boolean,first:bigint,past:bigint,mandatory:bigint>>")


def license_labels(docs: DataFrame, templates: dict[str, Iterable[str]], phrases: dict[str, str]) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan_licenses(docs, templates, phrases).withColumn("base", F.filter("places", lambda p: p.is_phrase))
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")
    starts, most = F.transform("base", lambda p: p.first), F.coalesce(F.array_max(F.transform("places", lambda p: p.mandatory)), F.lit(0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names("base").alias("base_labels"), names("places").alias("labels"), (most / (most + 4)).alias("score"),
    )


def as_pattern(nodes: list) -> str:
    """The template as a regular expression over words that each end in a blank (for the check by SQL)."""
    parts = []
    for node in nodes:
        if isinstance(node, bytes):
            parts.append(re.escape(node.decode()) + " ")
        elif isinstance(node, tuple):
            parts.append(f"(?:[^ ]+ ){{{node[0]},{node[1]}}}")
        elif isinstance(node, list):
            parts.append("(?:" + "|".join(as_pattern(x) for x in node) + ")")
        else:
            parts.append(f"(?:{as_pattern(node['optional'])})?")
    return "".join(parts)
