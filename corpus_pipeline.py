"""From raw documents to token ids in five stages; each takes (spark, docs, sf_dir).

Every stage but the last returns the columns of the documents it was given.
``run`` writes each stage's rows as Parquet in the shared folder and reads them
again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callscope.llm import bpe, decontaminate, minhash_dedup, quality_classifier, substring_dedup
from callscope.llm.common import stage_table

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, _read(spark, sf_dir, "labels"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id (5-word shingles, 0.8)."""
    return minhash_dedup.drop_near_duplicates(docs, k=5, threshold_percent=80)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that stand earlier already are cut out."""
    return substring_dedup.drop_repeats(docs, window=20, batches=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items are cut out; documents that are mostly such spans go."""
    return decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark"), n=10, max_coverage=0.5)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)."""
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_dedup", near_dedup),
    ("substring_dedup", substring),
    ("decontamination", decontamination),
    ("bpe", encode),
]

#: The classifier and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
