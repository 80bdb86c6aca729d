"""``run`` of the pipeline against a plain version of its five stages, on a small fixture with odd rows."""

import hashlib
import math
import struct

import brute
import corpus_pipeline
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from callscope.llm import quality_classifier

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"p{i}" for i in range(30))


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    good = max((d[1] for d in docs if d[1]), key=len)
    words = good.split()[:300]
    near = [*words[:150], "other", *words[151:]]
    item = items[0][1]
    more = [None, "", " \n", "one", " ".join(words), " ".join(near), f"{' '.join(words[:60])} {PASSAGE} ende", f"start {PASSAGE} {' '.join(words[100:180])}", f"{' '.join(words[:90])} {item} tail words", item]
    top = max(d[0] for d in docs)
    docs += [(top + 1 + k, t, None, None, None) for k, t in enumerate(more)] + docs[3:4]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items + [(None, "nothing of this is met anywhere at all in the other table of texts"), (10**9, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    return sf, docs, items


def cut(text, spans, gone):
    """The text without each run of gone words, from the first one's start to the last one's end."""
    out, at, k = "", 0, 0
    while k < len(spans):
        if k not in gone:
            k += 1
            continue
        last = k
        while last + 1 < len(spans) and last + 1 in gone:
            last += 1
        out += text[at : spans[k][0]]
        at, k = spans[last][1], last + 1
    return out + text[at:]


def plain(docs, items, model):
    def quality(text):
        data = (text or "").encode()
        if not data.strip():
            return model.base
        saved = 0
        for at in range(0, len(data), quality_classifier.BLOCK_BYTES):
            sizes = [
                len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(data[at : at + quality_classifier.BLOCK_BYTES]))
                for d in (model.good, model.bad)
            ]
            saved += sizes[1] - sizes[0]
        return 1 / (1 + math.exp(-(model.slope * saved / (len(data) + 64) + model.offset)))

    rows = {d[0]: d[1] for d in docs if quality(d[1]) >= 0.3}  # equal rows of one id are one document
    kept = {k for k, v in brute.near(list(rows.items()), 5).items() if v[2]}
    rows = {k: t for k, t in rows.items() if k in kept}
    first, left = {}, {}
    for k in sorted(rows):
        text = rows[k] or ""
        spans = [m.span() for m in brute.WORD.finditer(text)]
        w, gone = [text[a:b] for a, b in spans], set()
        for i in range(len(w) - 19):
            at = first.setdefault(tuple(w[i : i + 20]), (k, i))
            if at != (k, i):
                gone.update(range(i, i + 20))
        new = cut(text, spans, gone)
        if not gone or brute.WORD.search(new):
            left[k] = new if gone else rows[k]
    windows = set()
    for _, text in items:
        w = brute.folded(text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes, clean = {len(x) for x in windows}, {}
    for k, text in left.items():
        low = (text or "").translate(brute.AZ)
        spans = [m.span() for m in brute.FOLDED.finditer(low)]
        w = [low[a:b] for a, b in spans]
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not w or len(hit) / len(w) <= 0.5:
            clean[k] = cut(text, spans, hit) if hit else text
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    out = {}
    for k, text in clean.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        data = struct.pack(f"<{len(ids)}I", *ids)
        decoded = hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        out[k] = (len(ids), hashlib.sha256(data).hexdigest(), decoded, data)
    return out


def test_run_against_plain_stages(spark, fixture):
    sf, docs, items = fixture
    model = quality_classifier.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = corpus_pipeline.run(spark, sf).collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in rows}
    assert len(got) == len(rows) > 50
    assert got == plain(docs, items, model)


def test_stages_on_empty_tables_keep_the_columns(spark, fixture, tmp_path):
    sf = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{fixture[0]}/{name}.parquet").limit(0).write.parquet(f"{sf}/{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'x' as tie", "1 as n_words")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, sf).count() == 0
