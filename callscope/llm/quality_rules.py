"""Quality rules: hashed n-gram log-likelihood ratio against a trusted target.

Word unigrams and bigrams are hashed to buckets. Over all documents they give
the raw multinomial; over the trusted ones (labelled good) the target
multinomial. A document's score is the mean log ratio of the two over its
n-grams, and it is kept from a fixed threshold on, unless the base rules fail.

Texts are read once: their counts and bucket numbers (13 bits an n-gram) are
staged. Bucket counts are aggregated map-side, and the ratios come back as one
literal array of ``BUCKETS`` numbers, so no text is shuffled.

Defined results: null and empty texts have no words and fail the base rules;
without trusted documents all ratios are 0 and the base rules decide.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import BLANKS, join_ids, stage_table

BUCKETS, THRESHOLD, SMOOTHING = 1 << 13, -0.033, 4.0
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The words of a text, none of a blank one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))


def count_buckets(features: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target) over the n-grams of every document."""
    ids = stage_table(trusted.select("doc_id").distinct().withColumn("trusted", F.lit(1)), "trusted")
    rows = join_ids(features.select("doc_id", "grams"), ids, "doc_id", "left")
    rows = rows.select(F.coalesce("trusted", F.lit(0)).alias("t"), F.explode("grams").alias("bucket"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum(F.col("t").cast("long")).alias("target"))


def log_ratios(counts: DataFrame) -> list[float]:
    """log p_target - log p_raw by bucket, smoothed alike; 0 everywhere without a target."""
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():  # one row a bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    n, m = sum(raw), sum(target)
    if not n or not m:
        return [0.0] * BUCKETS
    p = [(r + SMOOTHING) / (n + SMOOTHING * BUCKETS) for r in raw]
    # The target is smoothed towards the raw corpus, so a bucket it hasn't met says little.
    return [math.log((t + SMOOTHING * BUCKETS * q) / (m + SMOOTHING * BUCKETS)) - math.log(q) for t, q in zip(target, p, strict=True)]


def repeat_words() -> Column:
    """Words in 3-word windows met twice or more in the text.

    Window hashes are sorted with their places in the low bits; equal neighbours
    whose words are equal too mark their places. Where a neighbour has the hash
    but not the words, all of that hash are looked through.
    """
    w = REPEAT_WINDOW
    same = "(words[{a}] = words[{b}] and words[{a} + 1] = words[{b} + 1] and words[{a} + 2] = words[{b} + 2])"
    a, b = "cast(s[{0}] & mask as int)", "cast(v & mask as int)"
    alike = lambda k: f"shiftright(s[{k}], bits) = shiftright(v, bits)"
    near = lambda k: f"{alike(k)} and " + same.format(a=a.format(k), b=b)
    beside = lambda test: f"(i > 0 and {test('i - 1')}) or (i < size(s) - 1 and {test('i + 1')})"
    other = "exists(s, u -> u <> v and shiftright(u, bits) = shiftright(v, bits) and " + same.format(a="cast(u & mask as int)", b=b) + ")"
    marked = f"transform(filter(s, (v, i) -> {beside(near)} or (({beside(alike)}) and {other})), v -> cast(v & mask as int))"
    covered = f"size(array_distinct(flatten(transform({marked}, p -> array({', '.join(f'p + {k}' for k in range(w))})))))"
    return F.expr(f"if(size(array_distinct(windows)) = size(windows), 0, {covered})").cast("long")


def text_features(docs: DataFrame) -> DataFrame:
    """(doc_id, the base counts, base_failed, grams: the bucket of every word and word pair)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    has_symbol = text.rlike(r"[#*$%&|<>]")
    n_symbols = F.when(has_symbol, F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0)
    n_dup_lines = F.size("lines") - F.size(F.array_distinct("lines"))
    return (
        docs.select("doc_id", words_of(F.col("text")).alias("words"), n_symbols.cast("long").alias("n_symbols"), lines.alias("lines"))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("hs", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("pairs", F.expr("if(n_words < 2, cast(array() as array<bigint>), transform(slice(hs, 1, cast(n_words as int) - 1), (x, i) -> xxhash64(x, hs[i + 1])))"))
        .withColumn("windows", F.expr("if(n_words < 3, cast(array() as array<bigint>), transform(slice(pairs, 1, cast(n_words as int) - 2), (x, i) -> x ^ shiftleft(hs[i + 2], 1)))"))
        .withColumn("bits", F.expr("cast(ceil(log2(n_words + 2)) as int)"))
        .withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
        .withColumn("s", F.expr("sort_array(transform(windows, (x, i) -> shiftleft(x, bits) | i))"))
        .withColumn("n_repeat_words", repeat_words())
        .select(
            "doc_id",
            "n_words",
            F.expr("aggregate(words, 0L, (a, w) -> a + char_length(w))").alias("word_chars"),
            "n_symbols",
            n_dup_lines.cast("long").alias("n_dup_lines"),
            "n_repeat_words",
            F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words").alias("base_failed"),
            F.expr(f"transform(concat(hs, pairs), x -> cast(x & {BUCKETS - 1} as smallint))").alias("grams"),
        )
    )


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every row."""
    features = stage_table(text_features(docs), "features")
    ratios = log_ratios(count_buckets(features, labels.where("quality = 1 and doc_id is not null")))
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # one literal of BUCKETS numbers
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(table, b.cast("int")))
    return (
        features.withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .drop("grams")
    )
