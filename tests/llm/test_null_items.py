"""Benchmark items without an id: they count as one item, their name is left out."""

import hashlib

from callscope.llm import decontaminate


def test_items_without_an_id(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(None, passage), (4, "other words " + passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "none")], "doc_id long, text string")
    names = {hashlib.sha256(x.encode()).hexdigest(): x for x in ("", "4")}
    only = {r.doc_id: (r.n_hit, r.n_items, names[r.items_sha256]) for r in decontaminate.scan_documents(docs, bench.where("item_id is null"), 10).collect()}
    both = {r.doc_id: (r.n_hit, r.n_items, names[r.items_sha256]) for r in decontaminate.scan_documents(docs, bench, 10).collect()}
    assert only == {1: (12, 1, ""), 2: (0, 0, "")} and both == {1: (12, 2, "4"), 2: (0, 0, "")}
