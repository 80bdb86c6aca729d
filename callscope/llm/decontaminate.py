"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items build one suffix automaton. Training text is
streamed through it word by word; the state and the length of the longest match
that ends at each word tell which item windows occur there. Words inside any
occurrence of a window are hit; spans of hit words are removed, and documents of
which they cover too much are dropped.

The automaton is built in a task and broadcast, so its size is checked first: a
benchmark beyond ``MAX_AUTOMATON_WORDS`` words is dealt to groups of items by
hash. Then each group's automaton is broadcast by itself and streamed over by
the documents, one pass a group; only the hits leave a pass. They are joined with
the texts by broadcast where they are checked to be few, else by text and salt,
so copies of a text aren't one task's. An item longer than an automaton may be is
cut into pieces that overlap by a window less a word, so none of its windows is lost.

Defined results: null and empty texts have no words; an item without words never
occurs; an empty benchmark hits nothing; repeated rows are judged one by one. An
item is known by its id: rows that share an id are one item, and all rows without
an id are one item, which counts but has no name.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import is_small, slices, stage_table, utf8

#: Words (about) of the items in one automaton (it is broadcast; a word costs about 1 kB at most).
MAX_AUTOMATON_WORDS = 100_000
#: Parts in which the rows of one text meet its hits, where these are too many to broadcast.
SALTS = 16
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_IS_WORD = [0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)]
#: Lower-cases A-Z and blanks every other byte that no word holds.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if _IS_WORD[b] else 0x20 for b in range(256))
_SPAN = re.compile(rb"[^ ]+")


def fold_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.n = n
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items if words]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        # Items by state: an item's own prefixes, and every suffix of theirs.
        self.items: list[set[int]] = [set() for _ in self.len]
        self.names = [item for item, _ in coded]
        self.short: dict[int, list[tuple[int, int]]] = {}  # state: (words, item) of items that are one window
        for k, (_, seq) in enumerate(coded):
            state = 0
            for c in seq:
                state = self.next[state][c]
                up = state
                while up > 0 and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]
            if len(seq) < n:
                self.short.setdefault(state, []).append((len(seq), k))
        # cut: the state of the last n words of a longer match; own: the short items that end in a state
        order = sorted(range(len(self.len)), key=self.len.__getitem__)
        self.cut, self.own = [0] * len(self.len), [()] * len(self.len)
        for v in order[1:]:
            up = self.link[v]
            self.cut[v] = self.cut[up] if self.len[up] >= n else v
            self.own[v] = (*self.short.get(v, ()), *self.own[up])

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.len[q] == self.len[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = self._state(self.len[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.len[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(-1)
        self.next.append(edges)
        return len(self.len) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans as disjoint (first, past last) word positions, and the items whose windows occur."""
        spans: list[list[int]] = []
        found: set[int] = set()
        state, length, n = 0, 0, self.n
        edges, link, lens, own = self.next, self.link, self.len, self.own
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                state = length = 0
                continue
            while state and c not in edges[state]:
                state = link[state]
                length = lens[state]
            state = edges[state].get(c, 0)
            length = length + 1 if state else 0
            widest = 0
            if length >= n:
                found |= self.items[self.cut[state]]
                widest = n
            for size, k in own[state]:
                if size <= length:
                    found.add(k)
                    widest = max(widest, size)
            if widest:
                lo = i + 1 - widest
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append([lo, i + 1])
        return [(a, b) for a, b in spans], found


def build_automata(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(group, automaton): pickled automata of about ``MAX_AUTOMATON_WORDS`` words each."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(TERM), F.lit(0))
    split = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"), words.alias("w")).withColumn("n", F.size("w"))
    whole = split.where(F.col("n") <= MAX_AUTOMATON_WORDS).select("k", utf8("t"), "n")
    step = max(1, MAX_AUTOMATON_WORDS - n + 1)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - n, F.lit(0)), F.lit(step))).alias("at")
    pieces = split.where(F.col("n") > MAX_AUTOMATON_WORDS).select("k", "w", starts).withColumn("w", F.slice("w", F.col("at") + 1, MAX_AUTOMATON_WORDS))
    items = whole.unionByName(pieces.select("k", F.array_join("w", " ").cast("binary").alias("t"), F.size("w").alias("n")))
    total = items.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    n_groups = max(1, -(-total // MAX_AUTOMATON_WORDS))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        own = sorted(zip(rows.k, rows.t, strict=True), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        machine = Automaton([(k, fold_words(bytes(t))) for k, t in own], n)
        return pd.DataFrame({"group": rows.group.iloc[:1], "automaton": [pickle.dumps(machine, pickle.HIGHEST_PROTOCOL)]})

    dealt = items.select("k", "t").withColumn("group", F.pmod(F.xxhash64("k", "t"), F.lit(n_groups)).cast("int"))
    return stage_table(dealt.groupBy("group").applyInPandas(build, "group int, automaton binary"), "automata")


def _scanned(batches: Iterator[pa.RecordBatch], machine) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with (text, folded text, words, spans, items) of its rows."""
    machine = pickle.loads(machine.value) if machine else None
    for batch in slices(batches):
        rows = []
        for data in batch.column("text"):
            data = data.as_py()
            folded = (data or b"").translate(_FOLD)
            words = folded.split()
            spans, found = machine.scan(words) if machine else ([], set())
            rows.append((data, folded, len(words), spans, [machine.names[k] for k in found]))
        yield batch, rows


def _report(rows: list, want_text: bool, max_coverage: float) -> list[pa.Array]:
    """Columns n_words, n_hit, n_items, items_sha256, clean, within of scanned rows."""
    out: list[list] = [[], [], [], [], [], []]
    for data, folded, n_words, spans, items in rows:
        hit = bytearray(n_words)
        for a, b in spans:
            hit[a:b] = b"\1" * (b - a)
        n_hit = sum(hit)
        out[0].append(n_words)
        out[1].append(n_hit)
        items = set(items)
        out[2].append(len(items))
        out[3].append(hashlib.sha256(",".join(sorted(k for k in items if k is not None)).encode()).hexdigest())
        out[4].append((_cut(data, folded, hit) if n_hit else data) if want_text else None)
        out[5].append(not n_words or n_hit / n_words <= max_coverage)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_())
    return [pa.array(v, t) for v, t in zip(out, types, strict=True)]


_REPORT = ["n_words", "n_hit", "n_items", "items_sha256", "clean", "within"]
_REPORT_DDL = "n_words long, n_hit long, n_items long, items_sha256 string, clean binary, within boolean"


def _scanner(machine, want_text: bool, max_coverage: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _scanned(batches, machine):
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + _report(rows, want_text, max_coverage), [*names, *_REPORT])

    return scan


def _hitter(machine):
    """(text_key, spans, items) of the texts that a group's items hit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("a", pa.int32()), ("b", pa.int32())])
        for _, rows in _scanned(batches, machine):
            hits = [(data, spans, items) for data, _, _, spans, items in rows if spans]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.md5(data).digest() for data, _, _ in hits], pa.binary()),
                    pa.array([[{"a": a, "b": b} for a, b in spans] for _, spans, _ in hits], pa.list_(span)),
                    pa.array([items for _, _, items in hits], pa.list_(pa.string())),
                ],
                ["text_key", "spans", "items"],
            )

    return scan


def _merger(want_text: bool, max_coverage: float):
    """The report of rows whose spans and items were found in several passes."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for data, spans, items in zip(*(batch.column(c) for c in ("text", "spans", "items")), strict=True):
                data = data.as_py()
                folded = (data or b"").translate(_FOLD)
                found = [(s["a"], s["b"]) for part in spans.as_py() or () for s in part]
                names = [i for part in items.as_py() or () for i in part]
                rows.append((data, folded, len(folded.split()), found, names))
            names = [c for c in batch.schema.names if c not in ("text", "spans", "items", "text_key")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + _report(rows, want_text, max_coverage), [*names, *_REPORT])

    return merge


def _reported(rows: DataFrame, benchmark: DataFrame, n: int, want_text: bool, max_coverage: float) -> DataFrame:
    """The columns of ``rows`` but ``text`` (binary), and the report's."""
    sc = rows.sparkSession.sparkContext
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    automata = build_automata(benchmark, n)
    groups = [r["group"] for r in automata.select("group").orderBy("group").collect()]
    machine = lambda g: sc.broadcast(bytes(automata.where(F.col("group") == g).first()["automaton"]))  # noqa: E731  about MAX_AUTOMATON_WORDS words
    if len(groups) < 2:
        return rows.mapInArrow(_scanner(machine(groups[0]) if groups else None, want_text, max_coverage), fields + _REPORT_DDL)
    hits: DataFrame | None = None
    for g in groups:
        own = machine(g)
        found = rows.select("text").mapInArrow(_hitter(own), "text_key binary, spans array<struct<a:int,b:int>>, items array<string>")
        found = stage_table(found.dropDuplicates(["text_key"]), f"hits{g}")
        own.destroy()
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("text_key").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))  # a row a group at most
    hits = stage_table(hits, "hits")
    keyed = rows.withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit(b"")))))
    if is_small(hits.select("text_key")) and is_small(hits.select(F.to_json(F.struct("spans", "items")).alias("all"))):
        joined = keyed.join(F.broadcast(hits), "text_key", "left")
    else:
        salted = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["text_key", "salt"], "left").drop("salt")
    return joined.mapInArrow(_merger(want_text, max_coverage), fields + _REPORT_DDL)


def _cut(data: bytes, folded: bytes, hit: bytearray) -> bytes:
    """The text without its runs of hit words; what stands between kept words stays."""
    kept, at = [], 0
    words = _SPAN.finditer(folded)
    for is_hit, run in itertools.groupby(zip(hit, words, strict=False), key=lambda x: x[0]):
        if is_hit:
            run = [m for _, m in run]
            kept.append(data[at : run[0].start()])
            at = run[-1].end()
        else:
            for _ in run:
                pass
    return b"".join([*kept, data[at:]])


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256."""
    return _reported(docs.select("doc_id", utf8()), benchmark, n, False, 0.0).drop("clean", "within")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """The documents' own columns, hit spans removed, and documents covered beyond ``max_coverage`` dropped."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(others)], utf8())
    out = _reported(rows, benchmark, n, True, max_coverage).where("within")
    back = {c: F.col(f"in_{k}") for k, c in enumerate(others)} | {"text": F.col("clean").cast("string")}
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("n_hit") > 0, F.length(back["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(back["n_chars"])
    return out.select(*[back[c].alias(c) for c in docs.columns])
