"""Scores of the classifiers against plain loops over their parameters; labels that contradict; long labelled texts."""

import math

import numpy as np
import pytest
import zstandard

from callscope.llm import common, langid, quality_classifier, toxicity
from callscope.llm.common import word_hashes

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    some = [bytes(r.text or "", "utf-8") for r in docs.where("doc_id % 25 = 0").collect()] + [b"", b"one", "Über ÉTÉ 12".encode(), b"x" * 9000]
    return docs, labels, some


def test_toxicity_by_loops(tables):
    docs, labels, texts = tables
    model = toxicity.fit(docs, labels)
    known = {int(h): k + 1 for k, h in enumerate(model.words)}
    fast = model.logits(toxicity.Texts.of([toxicity.text_words(data) for data in texts]))

    def vector(word):
        text = word.decode("utf-8", "ignore")
        named = [word, *(text[:n].encode() + b" *" for n in toxicity.STEMS if len(text) > n)]
        rows = [known[int(h)] for h in word_hashes(named) if int(h) in known]
        return sum(model.embed[r] for r in rows) / max(1, len(rows)) + np.zeros(toxicity.DIM)

    for data, z in zip(texts, fast, strict=True):
        words = [vector(w) for w in toxicity.text_words(data)]
        words += [np.zeros(toxicity.DIM)] * max(0, 3 - len(words))
        if len(words) >= 400:
            continue
        total, place = model.bias, 0
        for conv, shift in zip(model.conv, model.shift, strict=True):
            for f in range(toxicity.FILTERS):
                best = max(sum(float(words[i + o] @ conv[o][:, f]) for o in range(len(conv))) for i in range(len(words) - len(conv) + 1))
                total += max(best + float(shift[f]), 0.0) * float(model.out[place])
                place += 1
        assert z == pytest.approx(total, abs=1e-3)


def test_words_share_what_their_beginning_tells():
    """Toxic texts hold a stem with an ending that no other text has."""
    rng = np.random.RandomState(2)
    endings = [a + b + c for a in "aeiou" for b in "lmnrs" for c in "bdgkt"]
    sample = []
    for k in range(400):
        words = [f"w{rng.randint(60)}" for _ in range(15)]
        words[rng.randint(15)] = ("vermo" if k % 2 else f"z{k % 7}xq") + endings[rng.randint(len(endings))] + str(k)
        sample.append(([w.encode() for w in words], k % 2))
    model = toxicity.train(sample[:300])
    logits = model.logits(toxicity.Texts.of([words for words, _ in sample[300:]]))
    assert sum((z > model.cut[-1]) == bool(y) for z, (_, y) in zip(logits, sample[300:], strict=True)) >= 95


def test_wider_filters_tell_word_order():
    """Texts of one bag of words, toxic only where two words meet: word odds alone can't tell them."""
    rng = np.random.RandomState(1)
    sample = []
    for k in range(600):
        rest = [f"f{rng.randint(40)}" for _ in range(20)]
        at = rng.randint(18)
        pair = ["you", "rotter"]
        words = rest[:at] + pair + rest[at:] if k % 2 else [*rest[:at], "rotter", *rest[at:], "you"]
        sample.append(([w.encode() for w in words], k % 2))
    epochs, toxicity.EPOCHS = toxicity.EPOCHS, 40
    try:
        model = toxicity.train(sample[:500])
    finally:
        toxicity.EPOCHS = epochs
    logits = model.logits(toxicity.Texts.of([words for words, _ in sample[500:]]))
    right = [(z > model.cut[-1]) == bool(y) for z, (_, y) in zip(logits, sample[500:], strict=True)]
    assert sum(right) >= 85


def test_language_by_loops(tables):
    docs, _, texts = tables
    model = langid.fit(docs)
    for data in texts:
        if not langid.has_letter(data) or len(data) > 3000:
            continue
        words = data.decode("utf-8", "replace").lower().encode().translate(langid._BLANK).split()
        b = b" " + b" ".join(words) + b" "
        grams = [(i, size) for size in (2, 3, 4) for i in range(len(b) - size + 1)]
        z = np.array(model.bias, float)
        for i, size in grams:
            h = size
            for c in b[i : i + size]:
                h = ((h ^ c) * 0x9E3779B1) % (1 << 32)
                h ^= h >> 15
            z += model.table[h >> (32 - langid.BITS)] / len(grams)
        f = int(np.argmax(z[: len(model.families)]))
        wins = dict.fromkeys(model.members[f], 0)
        for k, (own, a, c) in enumerate(model.pairs):
            if own == f:
                wins[a if z[len(model.families) + k] > 0 else c] += 1
        lang, score = model.predict(data)
        assert wins[lang] == max(wins.values()) and 0 <= score <= 1


def test_shares_in_chunks(monkeypatch):
    text = " ".join(f"wort{i} über {i % 7}x" for i in range(400)).encode()
    whole = langid.shares(text)
    monkeypatch.setattr(langid, "CHUNK", 97)
    assert np.array_equal(langid.shares(text), whole) and whole.sum() == pytest.approx(1)


def test_quality_by_loops(tables):
    docs, labels, texts = tables
    model = quality_classifier.fit(docs, labels)
    score = model.scorer()
    for data in texts:
        if not data.strip():
            assert score(data) == model.base
            continue
        saved = 0
        for at in range(0, len(data), quality_classifier.BLOCK_BYTES):
            block = data[at : at + quality_classifier.BLOCK_BYTES]
            sizes = []
            for known in (model.good, model.bad):
                press = zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(known), write_content_size=False, write_dict_id=False)
                sizes.append(len(press.compress(block)))
            saved += sizes[1] - sizes[0]
        z = model.slope * saved / (len(data) + 64) + model.offset
        assert score(data) == pytest.approx(1 / (1 + math.exp(-z)))


def test_labels_that_contradict_and_long_texts(spark):
    docs = spark.createDataFrame([(k, "long " * 5000 if k % 2 else f"text {k}") for k in range(1, 60)] + [(60, None)], "doc_id long, text string")
    rows = [(k, int(k % 3 == 0), 0) for k in range(1, 61)] + [(3, 0, 0), (3, 1, 0), (4, None, 0), (None, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.quality for r in common.training_labels(labels, "quality").collect()}
    assert 3 not in kept and all(v == int(k % 3 == 0) for k, v in kept.items())
    # Most labelled texts are too long to be fitted on: the sample is drawn from the others, so both labels are met.
    sample = common.labelled_sample(docs, labels, "quality", 4, 100)
    assert {y for _, y in sample} == {0, 1} and all(len(t) < 100 for t, _ in sample)


def test_many_classes_share_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_CLASSES", 20)
    monkeypatch.setattr(common, "MAX_SAMPLE", 400)
    rows = spark.range(20_000).selectExpr("id as doc_id", "concat('l', cast(sqrt(id) as int) % 50) as lang")
    drawn = common.bounded_sample(rows, "lang", 500, "doc_id").groupBy("lang").count().collect()
    assert len(drawn) == 20 and 200 <= sum(r["count"] for r in drawn) <= 800
