"""Shared pieces of the training-data operators.

Every operator reads only the columns it names, so extra columns of the input
never clash with its own. Texts cross to Python as UTF-8 bytes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on exactly these.
BLANKS = r"[\x20\x09-\x0D]+"

#: Rows and bytes of an id table that may be broadcast; above them a shuffle join is used.
MAX_BROADCAST_IDS, MAX_BROADCAST_BYTES = 1_000_000, 16 << 20
#: Classes (labels, languages) that a sample tells apart, and rows that it has at most in all (or ten a class).
MAX_CLASSES, MAX_SAMPLE = 1_000, 8_000


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where a local session has none (tests), a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows doesn't repeat the work, and survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/callscope-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Empty the folder of a staged table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def is_small(ids: DataFrame, rows: int = MAX_BROADCAST_IDS, size: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a narrow table has at most so many rows and bytes; reads no more rows than needed to tell."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in ids.schema]
    found = ids.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(reduce(add, wide)).alias("b")).first()
    return found["n"] <= rows and (found["b"] or 0) <= size


def join_ids(df: DataFrame, ids: DataFrame, on: str | list[str], how: str, rows: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Join with a narrow table: broadcast if its rows and bytes are checked to be few, else shuffled."""
    return df.join(F.broadcast(ids) if is_small(ids, rows) else ids, on, how)


def in_fold(doc_id: str, mod: int, rest: int):
    """crc32 of the id as text, modulo ``mod``, equals ``rest``; null ids are in no fold."""
    return F.coalesce(F.expr(f"pmod(crc32(cast({doc_id} as string)), {mod}) = {rest}"), F.lit(False))


def text_tie(text: str = "text"):
    """64-bit hash of a text's bytes: tells the rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))


def utf8(name: str = "text"):
    return F.col(name).cast("binary").alias(name)


#: Bytes of text that a task works on at a time; a longer text is worked on alone.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into row ranges of about ``SLICE_BYTES`` of text, so what a task builds beside them stays as small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)
        del batch


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of ``n`` hashes, from prefix sums; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0 or n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h))
    sums = np.cumsum(h * up, dtype=np.uint64)
    runs = sums[n - 1 :].copy()
    runs[1:] -= sums[: m - 1]
    return mix(runs * down[:m] + np.uint64(n))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, ``label``) of 0 or 1 outside the held-out fold; documents whose labels contradict each other have none."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold("doc_id", 5, 0))
    return rows.groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("__most")).where(F.col(label) == F.col("__most")).drop("__most")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> list[tuple[bytes, int]]:
    """About ``per_class`` (text, label) of each label, in order, drawn from the labelled texts of up to ``max_chars`` characters."""
    texts = docs.select("doc_id", utf8()).where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    marked = stage_table(training_labels(labels, label).withColumnRenamed(label, "y"), "labels")
    usable = stage_table(join_ids(texts.select("doc_id").distinct(), marked, "doc_id", "inner"), "labelled")
    picked = stage_table(bounded_sample(usable, "y", per_class, "doc_id"), "picked")
    return sorted((bytes(r["text"]), r["y"]) for r in join_ids(texts, picked, "doc_id", "inner").select("text", "y").toLocalIterator())


def bounded_sample(df: DataFrame, by: str, per_class: int, key: str) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, by a hash of ``key``; deterministic.

    Only the counts of the ``MAX_CLASSES`` most frequent values reach the driver; rarer values are left out.
    With many values fewer rows are drawn of each, ``MAX_SAMPLE`` at most in all or ten a value.
    """
    most = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), by).limit(MAX_CLASSES)
    counts = {r[by]: r["n"] for r in most.collect()}
    per_class = min(per_class, max(10, MAX_SAMPLE // max(1, len(counts))))
    if not counts:
        return df.limit(0)
    draw = F.expr(f"pmod(xxhash64(cast({key} as string), 7), 1000000)")
    test = F.lit(False)
    for value, n in counts.items():
        test = test | (F.col(by).eqNullSafe(F.lit(value)) & (draw < int(min(1.0, per_class / n) * 1_000_000)))
    return df.where(test)
