import re

import brute
import pytest

from callscope.llm import licenses
from callscope.llm.license_templates import TEMPLATES
from callscope.llm.queries import LICENSE_PHRASES


def plain(template, options=True):
    """A text that a template accepts: with or without its optional regions, replaceable ones filled."""
    text = template.replace("<<", " <<").replace(">>", ">> ")
    while "<<beginOptional" in text:
        text = re.sub(r"<<beginOptional[^>]*>>((?:(?!<<beginOptional).)*?)<<endOptional>>", lambda m: m[1] if options else " ", text, flags=re.DOTALL)
    text = re.sub(r'<<var;words="(\d+),\d+">>', lambda m: "filler " * int(m[1]), text)
    return re.sub(r'<<var;any="([^|]*?)(?:\|.*?)?">>', lambda m: m[1], text, flags=re.DOTALL)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, []) for k, t in rows], "doc_id long, text string, labels string, n_words int, places array<int>")


def labels(spark, rows):
    return {r.doc_id: r for r in licenses.license_labels(frame(spark, rows), TEMPLATES, LICENSE_PHRASES).collect()}


def test_every_template_accepts_its_own_wording(spark):
    rows, want = [], {}
    for label, own in TEMPLATES.items():
        for template in own:
            for options in (True, False):
                for text in (plain(template, options), "before, " + plain(template, options).upper() + " after"):
                    want[len(rows)] = label
                    rows.append((len(rows), text))
    out = labels(spark, rows)
    assert all(want[k] in r.labels.split(",") for k, r in out.items())


def test_mandatory_wording_must_match_exactly(spark):
    words = licenses.fold_words(plain(TEMPLATES["isc"][0], False).encode())
    changed = [(k, b" ".join([*words[:k], b"changed", *words[k + 1 :]]).decode()) for k in range(len(words))]
    added = [(1000 + k, b" ".join([*words[:k], b"zzz", *words[k:]]).decode()) for k in range(1, len(words))]
    out = labels(spark, changed + added)
    fillers = {k for k, w in enumerate(words) if w == b"filler"}
    assert {k for k, r in out.items() if k < 1000 and "isc" in r.labels.split(",")} == fillers
    # a replaceable region may hold more words than it must
    assert {k - 1000 for k, r in out.items() if k >= 1000 and "isc" in r.labels.split(",")} == fillers | {k + 1 for k in fillers}


def test_places(spark):
    own = {"x": ['a <<beginOptional>>b<<endOptional>> c <<var;words="1,2">> d'], "y": ['a <<var;any="b c|c">> q']}
    rows = [(1, "A c 1 d"), (2, "a b c 1 2 d"), (3, "a c d"), (4, "a c 1 2 3 d"), (5, "a b c q a c q"), (6, "a c d d d"), (7, None), (8, "")]
    out = {r.doc_id: [(p.label, p.first, p.past) for p in r.places] for r in licenses.scan_licenses(frame(spark, rows), own, {"p": "c q"}).collect()}
    assert out == {1: [("x", 0, 4)], 2: [("x", 0, 6)], 3: [], 4: [], 5: [("y", 0, 4), ("p", 2, 4), ("y", 4, 7), ("p", 5, 7)], 6: [("x", 0, 5)], 7: [], 8: []}


def test_contract_on_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " ...! "), (4, "Under the MIT license. under THE mit, license"), (5, "CC-BY-NC 4.0 cc by nc"), (6, "Apache License, Version 2"), (7, "x " * 50_000 + "apache license version 20"),
            (8, "under the under the mit license"), (8, "under the under the mit license"), (None, "cc by ncé")]
    got = licenses.license_labels(frame(spark, rows), TEMPLATES, LICENSE_PHRASES).collect()
    for r in got:
        words = brute.folded(dict(rows)[r.doc_id])
        at = [(i, label) for label, p in LICENSE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        want = (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score < 1
    assert len(got) == len(rows) and licenses.license_labels(frame(spark, []), TEMPLATES, LICENSE_PHRASES).count() == 0


@pytest.mark.parametrize("bad", ["<<beginOptional>>a", "a<<endOptional>>", "<<other>>", '<<var;words="0,3">> a', ""])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        licenses.TokenAutomaton([bad])
