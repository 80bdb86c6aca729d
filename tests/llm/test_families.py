"""Near duplicates among documents that share much boilerplate; dropping row by row."""

import brute
from pyspark.sql import functions as F

from callscope.llm import minhash_dedup

SCHEMA = "doc_id long, text string, note string"


def family(n, shared=85, own=15):
    """Documents of which ``shared`` in a hundred words are the same; every tenth is a near copy of the one before."""
    base = [f"b{i}" for i in range(shared * 2)]
    rows = []
    for k in range(n):
        mine = [f"d{k - (k % 10 == 9)}x{i}" for i in range(own * 2)]
        rows.append((k, " ".join(base + mine + ([f"t{k}"] if k % 10 == 9 else []))))
    return rows


def test_prefixes_of_a_boilerplate_family(spark):
    """2,000 documents with 85 % in common give pairs in proportion to the near copies, not to all pairs."""
    rows = family(2_000)
    docs = spark.createDataFrame([(k, t, "") for k, t in rows], SCHEMA)
    sets = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(minhash_dedup._setter(4), "doc_id long, hashes array<long>")
    apart = docs.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("comp"))
    pairs = minhash_dedup.prefix_pairs(minhash_dedup.prefix_rows(apart, sets, 80), 80)
    assert 200 <= pairs.count() <= 4_000
    links = {(r.u, r.v) for r in pairs.collect()}
    assert {(k - 1, k) for k in range(9, 2_000, 10)} <= links


def test_family_against_brute_force(spark):
    for rows in (family(200), family(120, 92, 8)):
        docs = spark.createDataFrame([(k, t, "") for k, t in rows], SCHEMA)
        out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs, 4, 80).collect()}
        assert out == brute.near(rows, 4)


def test_blocks_find_what_pairs_find(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "PAIRED", 1)
    rows = family(200)
    docs = spark.createDataFrame([(k, t, "") for k, t in rows], SCHEMA)
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs, 4, 80).collect()}
    assert out == brute.near(rows, 4)


def test_blocks_with_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "PAIRED", 1)
    rows = family(60)
    docs = spark.createDataFrame([(k % 50, t, "") for k, t in rows], SCHEMA)
    groups = brute.near(rows, 4)
    out = minhash_dedup.near_duplicates(docs, 4, 80).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in out} == {True: sum(v[2] for v in groups.values()), False: sum(not v[2] for v in groups.values())}


def test_dropping_row_by_row(spark):
    text, near = " ".join(f"w{i}" for i in range(80)), " ".join(["changed", *(f"w{i}" for i in range(1, 80))])
    rows = [(1, text, "a"), (2, near, "b"), (2, "something else altogether", "c"), (None, text, "d"), (None, text, "e"), (4, "twice", "f"), (4, "twice", "f"), (5, None, "g"), (6, "", "h")]
    out = minhash_dedup.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA), 5, 80)
    want = [rows[0], rows[2], rows[3], rows[4], rows[5], rows[7], rows[8]]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
