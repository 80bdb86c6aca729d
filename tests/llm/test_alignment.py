import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from test_operators import docs  # noqa: F401
from tokenizers import Tokenizer

from callscope.llm import alignment
from callscope.llm.bpe import byte_alphabet

PATHS = (P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (1000, None), (1001, ""), (1002, " "), (1003, "Über ÉTÉ <|endoftext|> <s> \u3000 x\x1cy ▁ \x00 ﬁ ½"), (1004, "x" * 20_000), (1005, " " * 3000), (1006, "naïve ﬁne"),
    (1007, "日本語のテキスト 🎉"), (1008, "a\r\n\tb"), (None, "a b"), (3, "a b"), (3, "a b"), (1009, "plain <|endoftext|> and </s>"),
]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", 1, [2], 3) for k, t in rows], "doc_id long, text string, a string, row long, pairs array<int>, total int")


def spans(tokens):
    out, at = [], 0
    for k, b in tokens:
        out.append((k, at, at + len(b)))
        at += len(b)
    return out


def both(text):
    """(id, start, end) of either side's tokens, by the tokenizers' own libraries."""
    t, sp, back = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[2]), byte_alphabet()
    t.encode_special_tokens = True
    if not text:
        return [], []
    a = [(k, bytes(back[c] for c in t.id_to_token(k))) for k in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(k, bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()) for k in sp.encode(text)]
    whole = (" " + text).encode()
    return (spans(a), spans(b)) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else ([], [])


def brute(rows):
    counts, out = Counter(), []
    for k, text in rows:
        a, b = both(text)
        ends = {e: j for j, _, e in b}
        links = [(i, ends[e]) for i, _, e in a if e in ends]
        groups, lo = [], 0
        for e in [e for _, _, e in a if e in ends]:
            groups.append("|".join(",".join(str(i) for i, _, x in side if lo < x <= e) for side in (a, b)))
            lo = e
        counts.update(links)
        out.append((k, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return [(k, na, nb, ng, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), h) for k, na, nb, ng, x, h in out]


@pytest.mark.parametrize("broadcast", [400_000, 10])
def test_counts_and_groups(spark, docs, monkeypatch, broadcast):  # noqa: F811
    monkeypatch.setattr(alignment, "MAX_BROADCAST_PAIRS", broadcast)
    rows = docs[:40] + ODD
    got = alignment.alignment_counts(frame(spark, rows), *PATHS).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == sorted(brute(rows), key=str)
    assert alignment.alignment_counts(frame(spark, []), *PATHS).count() == 0


def test_overlaps_are_all_pairs_that_share_bytes(spark, docs):  # noqa: F811
    rows = [(k, (t or "")[:600]) for k, t in docs[:10]] + ODD[4:9]
    for r in alignment.align_tokens(frame(spark, rows), *PATHS).collect():
        a, b = both(dict(rows)[r.doc_id])
        assert [x.id for x in r.a] == [k for k, _, _ in a] and [x.id for x in r.b] == [k for k, _, _ in b]
        if len(a) < 2000:
            want = [(i, j) for i, (_, s, e) in enumerate(a) for j, (_, u, v) in enumerate(b) if s < v and u < e]
            assert [tuple(o) for o in r.overlaps] == want
        ends = {e for _, _, e in b}
        assert [x.group for x in r.a] == [sum(y in ends for _, _, y in a[:i]) for i in range(len(a))]


def test_very_long_blanks(spark):
    rows = [(1, "ab" + " " * 150_000 + "\n" * 3 + "c")]
    (got,) = alignment.alignment_counts(frame(spark, rows), *PATHS).collect()
    assert tuple(got[c] for c in COLUMNS) == brute(rows)[0]
