"""The fingerprint index: batches in several sessions, runs without a shuffle of history, ids of any type."""

import os
import subprocess
import sys
from pathlib import Path

import brute
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from callscope.llm import substring_dedup
from callscope.llm.common import utf8

ROOT = Path(__file__).resolve().parents[2]
WORDS = [f"w{i}" for i in range(400)]


def texts(lo, hi):
    """Documents that share passages with others before and after them, cut at odd places."""
    out = []
    for k in range(lo, hi):
        a, b = (k * 37) % 300, (k * 61) % 350
        out.append((k, " ".join([f"own{k}", *WORDS[a : a + 25 + k % 30], f"mid{k}", f"x{k % 5}", *WORDS[b : b + 19 + k % 9], f"end{k}"])))
    return out


def batch(spark, rows):
    return substring_dedup.with_tie(spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", utf8()))


def removed(rows, spans, window=20):
    gone = {k: set() for k, _ in rows}
    for r in spans:
        gone[r.doc_id].update(range(r.lo, r.lo + r.n + window - 1))
    return {k: len(g) for k, g in gone.items()}


def test_batches_in_several_sessions(spark, tmp_path):
    rows = texts(0, 60)
    want = {k: v[1] for k, v in brute.repeats(rows).items()}
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"), fanout=2)
    got = {}
    for lo in (0, 15, 30):
        part = rows[lo : lo + 15]
        got |= removed(part, index.add(batch(spark, part)).collect())
    assert sorted(index.runs) == ["run2_level1", "run3_level0"]  # compacted before the third
    index.save()
    index.close()
    # The old texts are gone for the new session, which sees the folder of the index only.
    script = (
        "import sys, json; from pyspark.sql import SparkSession; from callscope.llm import substring_dedup as s; from callscope.llm.common import utf8\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', 3).config('spark.ui.enabled', 'false')"
        f".config('spark.sql.warehouse.dir', '{tmp_path}/w').config('spark.checkpoint.dir', '{tmp_path}/shared').getOrCreate()\n"
        "rows = json.load(open(sys.argv[1])); index = s.FingerprintIndex.open(spark, sys.argv[2])\n"
        "new = index.add(s.with_tie(spark.createDataFrame(rows, 'doc_id long, text string').select('doc_id', utf8())))\n"
        "index.save(); print('SPANS', json.dumps([[r.doc_id, r.lo, r.n] for r in new.collect()]))\n"
    )
    import json
    from types import SimpleNamespace

    (tmp_path / "new.json").write_text(json.dumps(rows[45:]))
    env = os.environ | {"PYTHONPATH": f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", script, str(tmp_path / "new.json"), str(tmp_path / "index")], capture_output=True, text=True, env=env, cwd=tmp_path, timeout=300)
    assert "SPANS" in done.stdout, done.stderr[-3000:]
    spans = [SimpleNamespace(doc_id=k, lo=lo, n=n) for k, lo, n in json.loads(done.stdout.split("SPANS", 1)[1])]
    got |= removed(rows[45:], spans)
    assert got == want


def test_history_is_merged_without_a_shuffle_or_sort(spark, tmp_path):
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"), fanout=4)
    for lo in (0, 10, 20):
        index.add(batch(spark, texts(lo, lo + 10)))
    new = index.runs.pop("run2_level0")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        with substring_dedup.stored_order(spark):
            plans = [df._jdf.queryExecution().executedPlan().toString() for df in index.met(new)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(plans) == 3 and all("SortMergeJoin" in p and "Exchange" not in p for p in plans)
    assert all(" Sort [" not in p and "Sort [fp" not in p for p in plans)
    index.close()


def test_ten_batches_write_each_row_a_logarithmic_number_of_times(spark, tmp_path):
    rows = texts(0, 80)
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"), fanout=2)
    written, levels, got = 0, [], {}
    write = index._write

    def counted(run, level=0):
        nonlocal written
        name = write(run, level)
        written += spark.read.parquet(f"{index.path}/{name}").count()
        return name

    index._write = counted
    for lo in range(0, 80, 8):
        part = rows[lo : lo + 8]
        got |= removed(part, index.add(batch(spark, part)).collect())
        levels.append(sorted(map(substring_dedup.level_of, index.runs)))
    assert got == {k: v[1] for k, v in brute.repeats(rows).items()}
    assert levels[:5] == [[0], [0, 0], [0, 1], [0, 0, 1], [0, 2]] and max(map(len, levels)) <= 4
    own = sum(df.count() for df in index.runs.values())
    assert written <= own * 5  # four levels for ten batches
    index.close()


def test_a_task_passes_on_the_least_of_a_class(spark):
    passage = " ".join(WORDS[:60])
    rows = [(k, f"a{k} {passage} b{k}") for k in range(500)]
    one = batch(spark, rows).coalesce(1)
    members = one.mapInArrow(substring_dedup._segmenter(20), "fp long, seg long, doc_id long, tie long, lo int, n int, lead boolean")
    per_class = members.groupBy("fp", "seg").agg(F.count(F.lit(1)).alias("n"), F.count_if("lead").alias("leads"))
    inner = per_class.where("n = 500").collect()
    assert len(inner) >= 3 and all(r.leads == 1 for r in inner)


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_of_other_types(spark, kind):
    rows = texts(100, 140)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = {int(r.doc_id): (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, 20, 3).collect()}
    assert got == brute.repeats(rows)
    assert len(substring_dedup._cuts(docs, 3)) == 3


def test_dropping_keeps_rows_of_one_id_apart(spark):
    passage = " ".join(WORDS[:40])
    rows = [(1, passage, 5), (2, passage, 6), (2, "quite another text", 7), (None, f"{passage} tail", 8), (3, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie int")
    out = sorted(((r.doc_id, r.text, r.tie) for r in substring_dedup.drop_repeats(docs, 20, 2).collect()), key=str)
    assert out == sorted([(1, passage, 5), (2, "quite another text", 7), (None, " tail", 8), (3, None, 9)], key=str)
