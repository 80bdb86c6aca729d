"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled text. A text
is cut into blocks of equal size, each compressed with both; the difference of
the two compressed sizes, divided by the text's size, says which dictionary knows
the text better. A logistic curve fitted on other labelled rows makes it a
probability.

The dictionaries and the curve are fitted on a bounded sample of labelled rows
(``PER_CLASS`` rows a label, of those with texts up to ``MAX_FIT_CHARS``); every
document is scored whole.

Defined results: without labelled rows of both kinds every score is the share of
good rows (0.5 without any); empty and null texts get that share too; a document
whose labels contradict each other has none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import labelled_sample, slices, training_labels, utf8

PER_CLASS, MAX_FIT_CHARS = 1_500, 20_000
DICT_BYTES, BLOCK_BYTES, LEVEL = 48 * 1024, 2048, 3


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    base: float

    def scorer(self):
        if not self.good or not self.bad:
            return lambda data: self.base
        pair = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            for d in (self.good, self.bad)
        ]

        def score(data: bytes | None) -> float:
            if not data or not data.strip():
                return self.base
            return float(1 / (1 + np.exp(-(self.slope * difference(data, pair) + self.offset))))

        return score


def difference(data: bytes, pair: list) -> float:
    """Bytes that the good dictionary saves against the bad one, per byte of text."""
    good, bad = pair[0].compress, pair[1].compress
    total = 0
    for at in range(0, len(data), BLOCK_BYTES):
        block = data[at : at + BLOCK_BYTES]
        total += len(bad(block)) - len(good(block))
    return total / (len(data) + 64)


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[at : at + BLOCK_BYTES] for t in texts for at in range(0, len(t), BLOCK_BYTES)] or [b" "]
    size = min(DICT_BYTES, sum(map(len, blocks)) // 4)
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:  # too few blocks to train on: their bytes are the dictionary
        return b"".join(blocks)[-DICT_BYTES:]


def fit(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    rows = [r for r in labelled_sample(docs, labels, "quality", PER_CLASS, MAX_FIT_CHARS) if r[0].strip()]
    y = np.array([r[1] for r in rows], float)
    base = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return CompressionModel(b"", b"", 0.0, 0.0, base)
    prior = {r["quality"]: r["n"] for r in training_labels(labels, "quality").groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = prior.get(1, 0) / max(1, sum(prior.values()))
    # Lines that several texts share tell nothing of either kind and would fill the dictionaries.
    shared = Counter(line for text, _ in rows for line in set(text.split(b"\n")))
    # Of each label every second row trains its dictionary, the others fit the curve.
    turn = {0: 0, 1: 0}
    train: dict[int, list[bytes]] = {0: [], 1: []}
    curve: list[tuple[bytes, int]] = []
    for text, label in rows:
        turn[label] += 1
        (train[label].append(b"\n".join(x for x in text.split(b"\n") if shared[x] < 3)) if turn[label] % 2 else curve.append((text, label)))
    curve = curve or rows
    model = CompressionModel(_dictionary(train[1]), _dictionary(train[0]), 1.0, 0.0, base)
    pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    x = np.array([difference(t, pair) for t, _ in curve])
    model.slope, model.offset = logistic(x, np.array([k for _, k in curve], float))
    model.offset += float(np.log((base + 1e-3) / (1 - base + 1e-3)))  # from equal shares to the labels' own
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, both labels weighted alike, with a light ridge; Newton's method."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + np.array([0.1, 0.0]) * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([0.1, 1e-6])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def _scorer(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.scorer()
        for batch in slices(batches):
            k = batch.schema.names.index("text")
            scores = [score(data.as_py()) for data in batch.column(k)]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names)) if i != k] + [pa.array(scores, pa.float64())], [n for n in names if n != "text"] + ["score"]
            )

    return rows


def score_quality(docs: DataFrame, labels: DataFrame, model: CompressionModel | None = None) -> DataFrame:
    """(doc_id, score) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))  # two dictionaries of 48 kB
    rows = docs.select("doc_id", utf8())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model), f"doc_id {kind}, score double")


def _filter(model, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.scorer()
        for batch in slices(batches, "__quality_text"):
            keep = [score(data.as_py()) >= threshold for data in batch.column("__quality_text")]
            batch = batch.filter(pa.array(keep, pa.bool_()))
            yield batch.select([n for n in batch.schema.names if n != "__quality_text"])

    return rows


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents' own columns, without the documents scored under the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.withColumn("__quality_text", F.col("text").cast("binary")).mapInArrow(_filter(model, threshold), docs.schema)
