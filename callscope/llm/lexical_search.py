"""Ranked lexical search by reading impact-sorted lists in step (no random access).

The documents are counted once: terms a document, documents a query term. Then
each task deals its documents into blocks of a bounded number of postings and
sorts each block's postings of a term by impact. An item's lists are read from
the top in rounds. Each document met has a lower bound, the sum of what was
read, and an upper bound, which adds the last impact read of every list where it
hasn't been met. Reading goes on until no other document can reach the k-th
lower bound, ties included, and the bounds of those that can have met. So a
block's first k are exact, and the first k of all blocks are the answer.

No list is shuffled: a block is a part of a task's own documents, and k rows an
item and block leave it. Items go in passes of a bounded size (one pass for up
to ``MAX_QUERY_BYTES`` of query terms), as their terms and weights are broadcast.

Defined results: null and empty texts hold no term; an item without terms, or
whose terms no document holds or all documents hold (weight 0), has no rows.
Repeated items are answered one by one. Rows of one doc_id are documents of
their own; a null doc_id stands behind the others of its score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import slices, stage_table, utf8
from callscope.llm.decontaminate import fold_words
from callscope.llm.url_filter import LOWER, UPPER

#: Bytes of the items' distinct terms that are looked for in one pass over the documents.
MAX_QUERY_BYTES = 8 << 20
#: Postings of a block (about 60 bytes each while it is read), and how many entries of each list the first round reads.
BLOCK_POSTINGS, FIRST_READ = 1_500_000, 64
#: Parts in which an item's rows from the blocks are cut to k before they meet.
SALTS = 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def query_terms(items: DataFrame) -> DataFrame:
    """(row, item_id, grp, term, qtf): the distinct terms of each item, and the pass that the item is in."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    numbered = items.select(F.monotonically_increasing_id().alias("row"), "item_id", "text")  # before the terms are dealt out
    rows = numbered.select("row", "item_id", F.explode(found).alias("term"))
    terms = stage_table(rows.groupBy("row", "item_id", "term").agg(F.count(F.lit(1)).alias("qtf")), "query_terms")
    size = terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    return terms.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-size // MAX_QUERY_BYTES)))).cast("int"))


def _counter(shared):
    """(doc_id, n, terms, tf): how many terms a document has, and how often those that are asked for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in slices(batches):
            sizes, terms, tf = [], [], []
            for text in batch.column("text"):
                words = fold_words(text.as_py())
                held = Counter(map(number, words))
                held.pop(None, None)
                sizes.append(len(words))
                terms.append(list(held))
                tf.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tf"])

    return count


class Block:
    """Impact-sorted lists of some documents."""

    def __init__(self, doc_ids: pa.Array, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.size = doc_ids, len(n)
        self.place = np.empty(self.size, np.int64)  # of each document by ascending id, nulls last
        self.place[pc.sort_indices(doc_ids, null_placement="at_end").to_numpy()] = np.arange(self.size)
        doc = np.repeat(np.arange(self.size), sizes)
        m = 100 - 75 + (75 * n * n_docs) // max(1, n_terms)
        impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((-impact, terms))
        order = order[impact[order] > 0]
        self.doc, self.impact, terms = doc[order], impact[order], terms[order]
        self.first = np.searchsorted(terms, np.arange(len(weights) + 1))

    def best(self, terms: np.ndarray, qtf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, best first, read in step from the lists of ``terms``."""
        lists = [(lo, hi, q) for lo, hi, q in zip(self.first[terms], self.first[terms + 1], qtf, strict=True) if hi > lo]
        lower, seen = np.zeros(self.size, np.int64), np.zeros((len(lists), self.size), bool)
        open_docs, met = np.zeros(0, np.int64), np.zeros(self.size, bool)
        at, depth, closed = 0, FIRST_READ, not lists
        while lists:
            last = np.zeros(len(lists), np.int64)  # what an entry that hasn't been read can add at most
            new = []
            for t, (lo, hi, q) in enumerate(lists):
                docs = self.doc[lo + at : min(hi, lo + depth)]
                lower[docs] += q * self.impact[lo + at : min(hi, lo + depth)]
                seen[t, docs] = True
                if not closed:
                    new.append(docs[~met[docs]])
                    met[docs] = True
                if lo + depth < hi:
                    last[t] = q * self.impact[lo + depth - 1]
            open_docs = np.concatenate([open_docs, *new])
            rest = int(last.sum())
            bounds = lower[open_docs]
            kth = int(np.partition(bounds, -k)[-k]) if len(bounds) >= k else 1
            upper = bounds + rest - last @ seen[:, open_docs]
            able = upper >= kth
            open_docs = open_docs[able]
            closed = rest < kth  # no document that hasn't been met can reach the k-th, nor tie with it
            if closed and (upper[able] == bounds[able]).all():
                break
            at, depth = depth, depth * 2
        order = open_docs[np.lexsort((self.place[open_docs], -lower[open_docs]))][:k]
        return order, lower[order]


def _reader(shared, k: int):
    """(row, doc_id, score) of the k best of each item in each block of a task's documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n_docs, n_terms = shared.value
        held, size = [], 0

        def answer() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, n, terms, tf = (table.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "tf"))
            sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tf)]
            block = Block(ids, n.to_numpy(zero_copy_only=False), sizes, *flat, weights, n_docs, n_terms)
            found = [(row, *block.best(own, qtf, k)) for row, own, qtf in queries]
            rows = np.repeat(np.array([row for row, _, _ in found], np.int64), [len(d) for _, d, _ in found])
            docs, scores = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array(rows), ids.take(pa.array(docs)), pa.array(scores)], ["row", "doc_id", "score"])

        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= BLOCK_POSTINGS:
                yield answer()
                held, size = [], 0
        if held:
            yield answer()

    return read


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 of each item, equal scores by doc_id."""
    sc = docs.sparkSession.sparkContext
    terms = query_terms(items)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    best: DataFrame | None = None
    for (grp,) in terms.select("grp").distinct().orderBy("grp").collect():
        own = terms.where(F.col("grp") == grp).select("row", "term", "qtf").toPandas()  # MAX_QUERY_BYTES, or one item
        names, number = np.unique(own.term.to_numpy(object), return_inverse=True)
        known = sc.broadcast({t.encode(): i for i, t in enumerate(names)})
        counted = docs.select("doc_id", utf8()).mapInArrow(_counter(known), f"doc_id {id_type}, n long, terms array<int>, tf array<int>")
        counted = stage_table(counted, "counted")
        n_docs, n_terms = counted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(names), np.int64)
        for term, df in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():  # a row a query term
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        queries = [(int(row), number[at], own.qtf.to_numpy()[at]) for row, at in own.groupby("row").indices.items()]
        read = _reader(sc.broadcast((queries, weights, n_docs, n_terms)), k)
        found = counted.where(F.size("terms") > 0).mapInArrow(read, f"row long, doc_id {id_type}, score long")
        best = found if best is None else best.unionByName(found)
    if best is None:
        return terms.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(id_type).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for parts in (["row", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], ["row"]):  # both keep k rows a partition before they shuffle
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).where(F.col("rank") <= k)
    return best.join(terms.select("row", "item_id").distinct(), "row").select("item_id", "rank", "doc_id", "score")
