"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import (
    alignment,
    bpe,
    decontaminate,
    langid,
    lexical_search,
    licenses,
    minhash_dedup,
    oracle,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    toxicity,
    url_filter,
)
from callscope.llm.common import in_fold
from callscope.llm.license_templates import TEMPLATES

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: The phrases of the license query, by label.
LICENSE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: The rules of the URL query as (host, path, action).
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.host_path_rule(*r) for r in URL_RULES] + list(url_filter.DEFAULT_KEYWORDS)
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return quality_rules.judge_quality(docs.select("doc_id", "text"), labels)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    hits = decontaminate.scan_documents(docs, items, n=10)
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, labels)
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.predict_languages(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scored = quality_classifier.score_quality(docs, labels)
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_read(spark, sf_dir, "documents"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), window=20, batches=3)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"), k=4, threshold_percent=80)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(_read(spark, sf_dir, "documents"), TEMPLATES, LICENSE_PHRASES)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, public_tokenizers.path(PIECES)
    return alignment.alignment_counts(_read(spark, sf_dir, "documents"), *paths)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_quality_rules,
        op3_decontamination,
        op4_toxicity,
        op5_language_id,
        op6_quality_classifier,
        op7_sharding,
        op8_bpe,
        op9_substring_dedup,
        op10_minhash_dedup,
        op11_licenses,
        op12_lexical_search,
        op13_token_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": oracle.url_filters(URL_RULES, url_filter.DEFAULT_KEYWORDS),
    "op3_decontamination": oracle.decontamination(n=10),
    "op7_sharding": oracle.sharding(n_shards=8),
    "op9_substring_dedup": oracle.substring_dedup(window=20),
    "op10_minhash_dedup": oracle.near_duplicates(k=4, threshold_percent=80),
    "op11_licenses": oracle.licenses(TEMPLATES, LICENSE_PHRASES),
    "op12_lexical_search": oracle.ranked_search(k=10),
}
