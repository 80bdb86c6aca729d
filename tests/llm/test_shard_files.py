"""Files of the shards: every row, in the shard that it is placed in."""

from collections import Counter

from callscope.llm import sharding

SCHEMA = "doc_id long, text string, lang string"


def test_files_hold_null_ids_and_spread_repeated_rows(spark, tmp_path):
    rows = [(None, "no id", "en"), (None, None, "de"), (5, None, None)] + [(k, f"text {k}", "en") for k in range(10, 210)] + [(7, "again", "en")] * 100
    docs = spark.createDataFrame(rows, SCHEMA)
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    out = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r.doc_id, r.text, r.lang) for r in out.collect()) == Counter(rows)
    plain = lambda df: Counter((r.shard, r.doc_id) for r in df.select("shard", "doc_id").collect())
    assert plain(out) == plain(sharding.shard_documents(docs, 4))
    sizes = [sum(len(r.text or "") + 1 for r in out.where(f"shard = {s}").collect()) for s in range(4)]
    assert max(sizes) - min(sizes) <= 20


def test_files_of_an_empty_table(spark, tmp_path):
    sharding.write_shards(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), 4)
