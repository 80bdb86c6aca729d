import math
import re
from collections import Counter

import pytest
from brute import AZ
from test_operators import ODD, docs, items  # noqa: F401

from callscope.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(AZ) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):  # noqa: F811
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 100 - 75 + ((75 * n * n_docs) // max(1, total))
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "x", 1, []) for d, t in rows], "doc_id long, text string, term string, n int, terms array<int>").repartition(parts)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("first,block", [(64, 1_500_000), (1, 40)])
def test_ranks(spark, docs, items, monkeypatch, first, block):  # noqa: F811
    monkeypatch.setattr(lexical_search, "FIRST_READ", first)
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", block)
    own = items[:15] + [(900, None), (901, ""), (902, "..."), (903, "one ONE one nowhere"), (904, "same line same tail p3 p4 p5"), (905, "über été 12 12"), (906, "zzz-unknown")]
    rows = docs + [(1000 + d, t) for d, t in ODD] + [(None, "one two"), (1004, "one"), (1004, "one")]
    bench = spark.createDataFrame(own, "item_id long, text string")
    assert got(lexical_search.rank_documents(frame(spark, rows), bench)) == brute(rows, own)
    assert got(lexical_search.rank_documents(frame(spark, rows), bench, 3)) == brute(rows, own, 3)


def test_ties_at_the_last_rank_and_groups_of_items(spark, monkeypatch):
    rows = [(d, "common rare" if d % 3 else "common") for d in range(200)] + [(300 + d, f"other words {d}") for d in range(300)]
    own = [(1, "rare"), (2, "common rare other"), (3, "common"), (3, "common"), (4, "words 7")]
    bench = spark.createDataFrame(own, "item_id long, text string")
    want = brute(rows, own)
    assert got(lexical_search.rank_documents(frame(spark, rows, 7), bench)) == want
    monkeypatch.setattr(lexical_search, "MAX_QUERY_BYTES", 30)
    assert got(lexical_search.rank_documents(frame(spark, rows, 7), bench)) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search.rank_documents(frame(spark, ODD), none).count() == 0
    assert lexical_search.rank_documents(frame(spark, []), some).count() == 0
    everywhere = frame(spark, [(d, "one") for d in range(5000)])
    assert lexical_search.rank_documents(everywhere, some).count() == 0  # a term of all documents weighs nothing


def test_reading_stops_before_the_end_of_the_lists(spark):
    """A block whose lists settle early isn't read to the end."""
    import numpy as np
    import pyarrow as pa

    n = np.full(20_000, 50_000_000)
    tf = np.arange(1, 20_001)
    block = lexical_search.Block(pa.array(np.arange(20_000)), n, np.ones(20_000, np.int64), np.zeros(20_000, np.int64), tf, np.array([700]), 40_000, 2_000_000_000)
    read = []

    class Spy(np.ndarray):
        def __getitem__(self, at):
            read.append(at.stop - at.start if isinstance(at, slice) else 0)
            return np.asarray(self).__getitem__(at)

    block.doc = block.doc.view(Spy)
    order, scores = block.best(np.array([0]), np.array([2]), 10)
    assert list(order) == list(range(19_999, 19_989, -1)) and sum(read) == lexical_search.FIRST_READ and list(scores) == sorted(scores, reverse=True)
