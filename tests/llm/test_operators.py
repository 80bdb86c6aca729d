import hashlib
import struct

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callscope.llm import bpe, decontaminate, langid, minhash_dedup, quality_classifier, quality_rules, queries, sharding, substring_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(26))
#: Nulls, blanks, repeated rows, ties, a very long text, a shared passage, a planted near copy.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, f"alpha beta {PASSAGE} gamma"), (7, f"delta {PASSAGE} epsilon {PASSAGE}"),
    (8, LONG), (9, LONG + " tail"), (10, "Über ÉTÉ straße 12 <|endoftext|> \u3000 x\x1cy"), (11, "a a a a " * 30), (12, "same line\nsame line\n\nsame line"),
    (13, " ".join(f"n{i}" for i in range(60))), (14, " ".join(f"N{i}" for i in range(59)) + " changed"),
]


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    full = [(k, t, "en", "src", None, 1, "x", 2.0) for k, t in rows]
    return spark.createDataFrame(full, SCHEMA + ", n_words int, words string, score double")


def got(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


def test_urls(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://A.Example.com/en/x?q=1", "https://www.example.com/en/", "http://example.com", "http://example.com?x", "ftp://x.net/es/a#t",
            "http://xnet/es/", "http://notexample.com/en/1", "http://spam-farm.example.org/en/", "http://a.spam-farm.org/", "a://b://com/c", "http://cheap-pills.net/fr/", "http://com/"]
    urls += [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, tokens string")
    rules = [url_filter.host_path_rule(*r) for r in queries.URL_RULES] + list(url_filter.DEFAULT_KEYWORDS)
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}
    hints = [r.pattern for r in url_filter.DEFAULT_KEYWORDS]
    assert out == {i: brute.url(u, queries.URL_RULES, hints) for i, u in enumerate(urls)}
    monkeypatch.setattr(url_filter, "MAX_RULES", 3)  # more rules than one index holds are a table
    by_table = url_filter.judge_urls(df.withColumn("page_id", F.col("page_id") * 1), rules + [url_filter.keyword_rule("any", "casino")])
    hints.append("casino")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in by_table.collect()} == {i: brute.url(u, queries.URL_RULES, hints) for i, u in enumerate(urls)}
    monkeypatch.undo()
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert url_filter.judge_urls(df, []).where("verdict = 'allow'").count() == len(urls)


def test_quality_rules(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for rows in (docs, ODD):
        out = quality_rules.judge_quality(frame(spark, rows), labels)
        cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got(out, *cols) == {k: brute.base_counts(t) for k, t in rows}
        assert out.where("base_failed and kept").count() == 0
    assert quality_rules.judge_quality(frame(spark, []), labels).count() == 0
    none = quality_rules.judge_quality(frame(spark, docs), labels.limit(0))
    assert none.where("kept = base_failed").count() == 0


def test_quality_rules_score(spark):
    """The score is the mean log ratio of smoothed bucket shares."""
    import math

    rows = [(1, "good words here good words"), (2, "bad bad junk"), (3, "good words")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    frames = quality_rules.text_features(frame(spark, rows)).collect()
    grams = {r.doc_id: list(r.grams) for r in frames}
    assert [len(grams[k]) for k in (1, 2, 3)] == [9, 5, 3] and grams[3] == [grams[1][0], grams[1][1], grams[1][5]]
    raw, target = [b for g in grams.values() for b in g], grams[1]
    s, n = quality_rules.SMOOTHING, quality_rules.BUCKETS

    def ratio(b):
        q = (raw.count(b) + s) / (len(raw) + s * n)
        return math.log((target.count(b) + s * n * q) / (len(target) + s * n)) - math.log(q)

    out = got(quality_rules.judge_quality(frame(spark, rows), labels), "score")
    for k, g in grams.items():
        assert out[k][0] == pytest.approx(sum(map(ratio, g)) / len(g))


def test_decontamination(spark, docs, items):
    short = [(90, "One, two"), (91, None), (92, ""), (93, "w1x1 w2x2"), (94, PASSAGE)]
    for own_docs, own in ((docs, items), (ODD + [(20, "zero ONE two three"), (20 + 1, items[0][1])], items[:5] + short)):
        bench = spark.createDataFrame(own, "item_id long, text string")
        out = decontaminate.scan_documents(frame(spark, own_docs), bench, 10)
        want = brute.contamination(own_docs, own)
        assert {k: v + (v[1] > 0,) for k, v in got(out, "n_words", "n_hit", "n_items", "items_sha256").items()} == want
        kept = decontaminate.decontaminate(frame(spark, own_docs), bench, 10, 0.5)
        assert kept.columns == frame(spark, []).columns
        limit = {k for k, v in want.items() if not v[0] or v[1] / v[0] <= 0.5}
        assert {r.doc_id for r in kept.collect()} == limit
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan_documents(frame(spark, ODD), empty).where("n_hit > 0").count() == 0


def test_decontamination_in_several_automata(spark, docs, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_AUTOMATON_WORDS", 60)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.build_automata(bench, 10).count() > 2
    out = decontaminate.scan_documents(frame(spark, docs), bench, 10)
    assert got(out, "n_words", "n_hit", "n_items", "items_sha256") == {k: v[:4] for k, v in brute.contamination(docs, items).items()}


@pytest.mark.parametrize("most,small", [(100_000, True), (60, True), (60, False), (12, True)])
def test_decontamination_by_items_of_one_id_or_none(spark, docs, items, monkeypatch, most, small):
    """Rows that share an id are one item, those without one are one without a name, in one automaton, in several, and cut into pieces."""
    monkeypatch.setattr(decontaminate, "MAX_AUTOMATON_WORDS", most)
    monkeypatch.setattr(decontaminate, "is_small", lambda df: small)
    own = [("a", items[0][1]), ("a", items[1][1]), ("a", items[0][1]), (None, items[0][1]), (None, items[2][1]), ("b", None), ("c", PASSAGE)]
    rows = docs + [(1001, f"x {items[0][1]} y"), (1002, items[1][1] + " and " + items[2][1]), (1003, items[0][1]), (1003, items[0][1]), (1004, None), (1005, ""), (1006, PASSAGE), (1006, PASSAGE)]
    out = decontaminate.scan_documents(frame(spark, rows), spark.createDataFrame(own, "item_id string, text string"), 10)
    assert got(out, "n_words", "n_hit", "n_items", "items_sha256") == {k: v[:4] for k, v in brute.contamination(rows, own).items()}
    assert out.count() == len(rows)


@pytest.mark.parametrize("copies", [1, 2])
def test_sharding(spark, docs, copies):
    out = sharding.shard_documents(frame(spark, docs * copies), 8)
    if copies == 1:
        assert got(out, "size", "text_crc32", "shard", "slot") == brute.shards(docs)
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    most = max(r.size for r in rows)
    sums = [sum(r.size for r in by.get(s, [])) for s in range(8)]
    assert max(sums) - min(sums) <= 2 * most
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    odd = sharding.shard_documents(frame(spark, ODD + [(None, "x")]), 8).collect()
    assert len(odd) == len(ODD) + 1 and sharding.shard_documents(frame(spark, []), 8).count() == 0


def test_bpe(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    rows = docs + [(1000 + k, x) for k, x in ODD] + [(2000, "x" * 5000), (2001, "don't  we'll\n\n  ' 's ½ ٣ 𝒳 ‍ \u2028 \x85 \xa0 " * 3)]
    path, pattern = public_tokenizers.path(queries.TOKENIZER), public_tokenizers.PATTERN
    want = {}
    for k, x in rows:
        e = t.encode(x or "", add_special_tokens=False).ids
        want[k] = (len(e), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest(), brute.sha(t.decode(e, skip_special_tokens=False)))
    out = bpe.encode_documents(frame(spark, rows), path, pattern)
    assert got(out, "n_tokens", "ids_sha256", "decoded_sha256") == want
    v = bpe.Vocabulary(path)
    ids = {r.doc_id: bytes(r.ids) for r in bpe.encode_documents(frame(spark, rows), path, pattern, True).collect()}
    assert all(bpe.decode_ids(ids[k], v) == (x or "") for k, x in rows)
    assert bpe.encode_documents(frame(spark, []), path, pattern).count() == 0


def test_bpe_every_token(spark):
    v = bpe.Vocabulary(public_tokenizers.path(queries.TOKENIZER))
    t = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    texts = [b.decode() for b in v.ids if b.decode("utf-8", "ignore").encode() == b]
    enc = bpe.TrieEncoder(v)
    words = {w for x in texts for w in bpe.regex.findall(public_tokenizers.PATTERN, x)}
    enc.encode(words)
    for w in sorted(words):
        assert list(struct.unpack(f"<{len(enc.known[w]) // 4}I", enc.known[w])) == t.encode(w, add_special_tokens=False).ids


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(spark, docs, batches):
    for rows in (docs, ODD):
        out = substring_dedup.remove_repeats(frame(spark, rows), 20, batches)
        assert got(out, "n_words", "n_removed", "kept_sha256") == brute.repeats(rows)


def test_substring_dedup_small_windows_and_odd_tables(spark):
    rows = [(k, " ".join("ab"[(k * i * i + i) % 2] for i in range(40))) for k in range(12)]
    out = substring_dedup.remove_repeats(frame(spark, rows), 7, 3)
    assert got(out, "n_words", "n_removed", "kept_sha256") == brute.repeats(rows, 7)
    assert substring_dedup.remove_repeats(frame(spark, []), 20, 2).count() == 0
    rows = ODD + [(None, PASSAGE), (1, PASSAGE), (1, PASSAGE), (None, f"more {PASSAGE} here"), (13, " ".join(f"u{i}" for i in range(32))), (None, "short")]
    for batches in (1, 3):
        odd = substring_dedup.remove_repeats(frame(spark, rows), 20, batches).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in odd), key=str) == brute.repeats_by_row(rows)
    kept = substring_dedup.drop_repeats(frame(spark, ODD), 20, 2)
    assert kept.columns == frame(spark, []).columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[7] == "delta  epsilon " and 9 in texts and texts[9] == " tail" or len(texts[9].split()) <= 20


def test_near_duplicates(spark, docs):
    for rows, k in ((docs, 4), (ODD, 4), (docs, 5)):
        out = minhash_dedup.near_duplicates(frame(spark, rows), k, 80)
        assert got(out, "n_shingles", "component_id", "kept") == brute.near(rows, k)
    assert minhash_dedup.near_duplicates(frame(spark, []), 5).count() == 0
    out = minhash_dedup.near_duplicates(frame(spark, [(None, "a b"), (3, "a b"), (3, "a b"), (4, "a b")]), 5)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out.collect()) == [(0, 0, True), (3, 3, True), (3, 3, True), (4, 3, False)]


def test_near_duplicates_of_a_loose_family(spark):
    """Copies that are near to some of the others only: hubs alone don't link them all."""
    import random

    r = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for at in r.sample(range(120), r.choice((1, 2, 3, 4))):
            w[at] = f"c{r.randrange(40)}"
        rows.append((k, " ".join(w)))
    out = minhash_dedup.near_duplicates(frame(spark, rows), 4, 80)
    assert got(out, "n_shingles", "component_id", "kept") == brute.near(rows, 4)
    kept = minhash_dedup.drop_near_duplicates(frame(spark, rows + rows[:1]), 4, 80)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(k for k, v in brute.near(rows, 4).items() if v[2])


def test_near_duplicates_around_a_hub(spark, monkeypatch):
    """One document that very many others are near to, and one text that very many rows have: parts and the lookup of hot classes."""
    monkeypatch.setattr(minhash_dedup, "HUB_PART", 8)
    monkeypatch.setattr(minhash_dedup, "HOT_CLASS", 20)
    base = [f"b{i}" for i in range(100)]
    rows = [(0, " ".join(base))] + [(k, " ".join([*base[:97], f"x{k}", f"y{k}", f"z{k}"])) for k in range(1, 60)]
    rows += [(100 + k, "copy of one text that many rows have") for k in range(30)] + [(200 + k, None) for k in range(25)]
    out = minhash_dedup.near_duplicates(frame(spark, rows), 4, 80)
    assert got(out, "n_shingles", "component_id", "kept") == brute.near(rows, 4)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "u long, v long")
    out = {r.node: r.component for r in minhash_dedup.components(chain).collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_classifiers_held_out(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 holds out six toxic texts only
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r for r in l.collect()}
    for query, label in ((queries.op4_toxicity, "toxic"), (queries.op6_quality_classifier, "quality")):
        held = [(r.predicted, truth[r.doc_id][label]) for r in query(spark, sf).collect() if r.held_out and r.doc_id in truth]
        right = [sum(p == y for p, y in held if y == k) / max(1, sum(y == k for _, y in held)) for k in (0, 1)]
        assert len(held) > 30 and min(right) > 0.7, (label, right)
    lang = {r.doc_id: r.lang for r in d.collect()}
    held = [r.lang_pred == lang[r.doc_id] for r in queries.op5_language_id(spark, sf).collect() if r.held_out]
    assert sum(held) / len(held) > 0.95


def test_classifiers_on_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = frame(spark, ODD)
    assert {r.score for r in toxicity.score_toxicity(rows, labels).collect()} == {0.0}
    assert {r.score for r in quality_classifier.score_quality(rows, labels).collect()} == {0.5}
    found = got(langid.predict_languages(rows), "lang_pred", "score")
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] == "en"
    none = langid.predict_languages(rows.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    few = spark.createDataFrame([(6, 1, 1), (7, 0, 0), (8, 1, 0), (13, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for scored in (toxicity.score_toxicity(rows, few), quality_classifier.score_quality(rows, few)):
        assert all(0 <= r.score <= 1 for r in scored.collect()) and scored.count() == len(ODD)
    assert quality_classifier.keep_good(rows, labels, 0.3).columns == rows.columns
