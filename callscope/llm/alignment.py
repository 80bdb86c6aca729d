"""Alignment of the token sequences that two tokenizers give for one text.

Tokens are byte ranges of a blank and the text. In Arrow batches, two
``merge_asof`` calls keyed by document find, for each token start, the token of
the other side that covers it; both directions together are all overlapping
pairs. A pair whose ranges end together is a link, and its end cuts both
sequences into groups.

How often two ids are linked in the whole corpus is counted by Spark from the
distinct pairs of each document. The counts (at most one a pair of ids) are
broadcast where they are checked to be few; else they are joined by pair, dealt
by salt, so a pair that stands in a third of the documents isn't one task's.

Defined results: null and empty texts, texts that aren't valid UTF-8, and texts
that a tokenizer changes (the bytes of its tokens aren't those of a blank and
the text) have no tokens. Special tokens written in a text are plain text.
Repeated rows, and rows of one id or none, are aligned one by one; each counts.
A text is aligned as a whole, in memory in proportion to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.bpe import TrieEncoder, Vocabulary, splitter, unpacked
from callscope.llm.common import is_small, slices, stage_table, utf8

#: Pairs of ids whose counts may be broadcast (they are measured first), and into how many parts a pair's rows are dealt else.
MAX_BROADCAST_PAIRS, SALTS = 400_000, 16
#: A run of blanks that is too long for the split of the first tokenizer's library; such a text goes through the trie of ``bpe``.
LONG_BLANKS = re.compile(r"\s{100000}")


class Sides:
    """Both tokenizers, made in a task from the broadcast contents of their files."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, model: bytes):
        self.vocabulary, self.split = vocabulary, splitter(pattern)
        ranks = {b: k for b, k in vocabulary.ids.items() if k not in vocabulary.special.values()}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = [b""] * (1 + max(ranks.values()))
        for token, k in ranks.items():
            self.a_bytes[k] = token
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(t) for t in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        # each id in decimal behind each mark that may stand before it
        self.a_names, self.b_names = ({m: _names(m, len(own)) for m in marks} for own, marks in ((self.a_bytes, (b",", b";")), (self.b_bytes, (b",", b"|"))))

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def encode(self, data: bytes | None) -> tuple[list[int], list[int]]:
        """The ids of both sides; none where the text is empty or a side changes it."""
        try:
            text = (data or b"").decode()
        except UnicodeDecodeError:
            return [], []
        whole = b" " + (data or b"")
        b = self.b.encode(text, num_threads=1) if text else []
        if not b or b"".join([self.b_bytes[k] for k in b]) != whole:
            return [], []
        a = self._with_long_blanks(" " + text) if LONG_BLANKS.search(text) else self.a.encode_ordinary(" " + text)
        return (a, b) if b"".join([self.a_bytes[k] for k in a]) == whole else ([], [])

    def _with_long_blanks(self, text: str) -> list[int]:
        encoder, words = TrieEncoder(self.vocabulary), list(self.split(text))
        encoder.encode(set(words))
        return [k for w in words for k in unpacked(encoder.known[w])]


def _names(mark: bytes, n: int) -> np.ndarray:
    return np.array([mark + str(k).encode() for k in range(n)], object)


class Aligned:
    """The tokens of some documents, one after the other, and their alignment."""

    def __init__(self, sides: Sides, texts: list[bytes | None]):
        coded = [sides.encode(t) for t in texts]
        self.n_docs = len(coded)
        self.a, self.a_doc = self._joined([a for a, _ in coded])
        self.b, self.b_doc = self._joined([b for _, b in coded])
        # documents stand one after the other on one axis of bytes, so starts ascend as merge_asof asks
        a_end, b_end = np.cumsum(sides.a_len[self.a]), np.cumsum(sides.b_len[self.b])
        left = pd.DataFrame({"doc": self.a_doc, "at": a_end - sides.a_len[self.a], "i": np.arange(len(self.a))})
        right = pd.DataFrame({"doc": self.b_doc, "at": b_end - sides.b_len[self.b], "j": np.arange(len(self.b))})
        over_b = pd.merge_asof(left, right, on="at", by="doc")["j"].to_numpy(np.int64)  # the token of b that covers each start of a
        over_a = pd.merge_asof(right, left, on="at", by="doc")["i"].to_numpy(np.int64)
        # tokens that start together are met in both directions
        own = left["at"].to_numpy()[over_a] != right["at"].to_numpy() if len(over_a) else np.zeros(0, bool)
        self.over_i = np.concatenate([np.arange(len(self.a)), over_a[own]])
        self.over_j = np.concatenate([over_b, np.arange(len(self.b))[own]])
        even = a_end[self.over_i] == b_end[self.over_j]
        self.link_i, self.link_j = np.sort(self.over_i[even]), np.sort(self.over_j[even])  # links don't cross
        self.a_group, self.b_group = self._groups(self.link_i, len(self.a)), self._groups(self.link_j, len(self.b))

    @staticmethod
    def _joined(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.array(p, np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
        return ids, np.repeat(np.arange(len(parts)), [len(p) for p in parts])

    @staticmethod
    def _groups(ends: np.ndarray, n: int) -> np.ndarray:
        """The group of each token: how many groups ended before it."""
        last = np.zeros(n + 1, np.int64)
        last[ends + 1] = 1
        return np.cumsum(last)[:n]

    def counts(self, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=self.n_docs)

    def digests(self, sides: Sides) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` of each document; empty for one without tokens."""
        n_groups = len(self.link_i)
        a_sizes, b_sizes = np.bincount(self.a_group, minlength=n_groups), np.bincount(self.b_group, minlength=n_groups)
        a_at = np.arange(len(self.a)) + (np.cumsum(b_sizes) - b_sizes)[self.a_group]
        b_at = np.arange(len(self.b)) + np.cumsum(a_sizes)[self.b_group]
        parts = np.empty(len(self.a) + len(self.b), object)
        for ids, groups, at, names, first in ((self.a, self.a_group, a_at, sides.a_names, b";"), (self.b, self.b_group, b_at, sides.b_names, b"|")):
            opens = np.diff(groups, prepend=-1) > 0
            parts[at[opens]] = names[first][ids[opens]]
            parts[at[~opens]] = names[b","][ids[~opens]]
        out, at = [], 0
        for n in (self.counts(self.a_doc) + self.counts(self.b_doc)).tolist():
            out.append(hashlib.sha256(b"".join(parts[at : at + n].tolist())[1:]).hexdigest() if n else "")
            at += n
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, id of a, id of b, links) of the distinct linked pairs, by document."""
        a, b, doc = self.a[self.link_i], self.b[self.link_j], self.a_doc[self.link_i]
        width_a, width_b = int(a.max(initial=0)) + 1, int(b.max(initial=0)) + 1
        code, n = np.unique((doc * width_a + a) * width_b + b, return_counts=True)
        return code // (width_a * width_b), code // width_b % width_a, code % width_b, n


def _lists(sizes: np.ndarray, fields: dict[str, np.ndarray]) -> pa.ListArray:
    """Rows of ``sizes`` structs each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in fields.values()], list(fields)))


def _in_tasks(docs: DataFrame, a_path: str, pattern: str, b_path: str, report, fields: str) -> DataFrame:
    """The columns of ``docs`` but ``text`` (binary), and those of ``report``."""
    with open(b_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((Vocabulary(a_path), pattern, f.read()))  # as large as the tokenizers' files

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides(*shared.value)
        for batch in slices(batches):
            columns = report(sides, Aligned(sides, [t.as_py() for t in batch.column("text")]))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns.values()], [*names, *columns])

    own = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.mapInArrow(align, own + fields)


def _overlaps(sides: Sides, x: Aligned) -> dict[str, pa.Array]:
    a_n, b_n = x.counts(x.a_doc), x.counts(x.b_doc)
    a_0, b_0 = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
    order = np.lexsort((x.over_j, x.over_i))
    i, j = x.over_i[order], x.over_j[order]
    doc = x.a_doc[i]
    a, b = _lists(a_n, {"id": x.a, "group": x.a_group - x.a_group[a_0[x.a_doc]]}), _lists(b_n, {"id": x.b, "group": x.b_group - x.b_group[b_0[x.b_doc]]})
    return {"a": a, "b": b, "overlaps": _lists(x.counts(doc), {"a": i - a_0[doc], "b": j - b_0[doc]})}


def align_tokens(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """(doc_id, a, b, overlaps): both sides' tokens with the group that each is in, and the places of all pairs that share bytes."""
    fields = "a array<struct<id:int,group:int>>, b array<struct<id:int,group:int>>, overlaps array<struct<a:int,b:int>>"
    return _in_tasks(docs.select("doc_id", utf8()), a_path, pattern, b_path, _overlaps, fields)


def _digest(sides: Sides, x: Aligned) -> dict[str, pa.Array]:
    doc, a, b, n = x.pairs()
    n_groups = x.counts(x.a_doc[x.link_i])
    numbers = {"n_a": x.counts(x.a_doc), "n_b": x.counts(x.b_doc), "n_groups": n_groups, "n_links": n_groups, "n_overlaps": x.counts(x.a_doc[x.over_i])}
    out = {k: pa.array(v.astype(np.int64)) for k, v in numbers.items()}
    return out | {"groups_sha256": pa.array(x.digests(sides), pa.string()), "pairs": _lists(x.counts(doc), {"a": a, "b": b, "n": n})}


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, total, is_best) of each linked pair of ids: its links in all documents, and whether ``b`` has no pair with more."""
    counts = aligned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum(F.col("p.n").cast("long")).alias("total"))
    counts = stage_table(counts, "pairs")
    most = counts.groupBy("b").agg(F.max("total").alias("most"))  # at most a row an id of b
    return counts.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("is_best"))


def alignment_counts(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), utf8())
    fields = "n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<struct<a:int,b:int,n:int>>"
    aligned = stage_table(_in_tasks(rows, a_path, pattern, b_path, _digest, fields), "aligned")
    counts = stage_table(pair_counts(aligned), "counts")
    kept = [c for c in aligned.columns if c not in ("row", "pairs")]
    each = aligned.select("row", *kept, F.explode_outer("pairs").alias("p")).select("row", *kept, "p.*")
    if is_small(counts, MAX_BROADCAST_PAIRS):
        met = each.join(F.broadcast(counts), ["a", "b"], "left")
    else:
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(salted, ["a", "b", "salt"], "left")
    # a broadcast leaves a row's pairs in their partition, so one row a document is shuffled
    return met.groupBy("row").agg(
        *[F.first(c).alias(c) for c in kept],
        F.coalesce(F.sum(F.when(F.col("is_best"), F.col("n").cast("long"))), F.lit(0)).alias("n_best"),
        F.coalesce(F.sum(F.col("n") * F.col("total")), F.lit(0)).alias("count_sum"),
    ).drop("row")
