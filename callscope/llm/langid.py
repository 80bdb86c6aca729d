"""Language identification in two steps: family first, then languages within it.

Texts become frequencies of hashed byte n-grams of their letters. A softmax
regression picks the language family; inside a family every pair of languages
has a linear support vector machine, and the language with most pairwise wins
(then the largest summed margin) is predicted. All models are linear in the
n-gram frequencies, so a text is scored by one product of its shares.

Fitted on a bounded sample of ``PER_LANG`` rows a language, of those with texts of
up to ``MAX_FIT_CHARS`` (fewer a language, and the most frequent languages only,
beyond the bounds of ``bounded_sample``); every document is predicted from its
whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without training rows everything is ``und``; with one language it is that one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import bounded_sample, in_fold, slices, utf8

PER_LANG, MAX_FIT_CHARS, BITS = 500, 6_000, 13
#: Bytes of a text whose n-grams are counted at a time.
CHUNK = 1 << 18

#: Families of ISO 639-1 codes; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk"),
    "indo-aryan": ("hi", "ur", "bn", "pa", "gu", "mr", "ne", "si"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("ar", "he", "mt", "am"),
    "celtic": ("ga", "gd", "cy", "br"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

_BLANK = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(data: bytes | None) -> bool:
    if not data:
        return False
    return bool(_ASCII_LETTER.search(data)) or any(c.isalpha() for c in data.decode("utf-8", "replace"))


def shares(data: bytes) -> np.ndarray:
    """Shares of the byte bigrams, trigrams and 4-grams of the lower-cased letters by bucket; words are set apart by one blank."""
    words = data.decode("utf-8", "replace").lower().encode().translate(_BLANK).split()
    text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    counts = np.zeros(1 << BITS, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(text), CHUNK):
            for n in (2, 3, 4):
                b = text[at : at + CHUNK + n - 1].astype(np.uint32)
                m = len(b) - n + 1
                if m < 1:
                    continue
                h = np.full(m, n, np.uint32)
                for k in range(n):
                    h = (h ^ b[k : k + m]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                counts += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    return (counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class Hierarchy:
    families: list[str]
    members: list[list[str]]
    pairs: list[tuple[int, str, str]] = field(default_factory=list)  # family, first, second
    table: np.ndarray = None  # weights by bucket: the families', then the pairs'
    bias: np.ndarray = None

    def predict(self, data: bytes | None) -> tuple[str, float]:
        if not self.families or not has_letter(data):
            return "und", 0.0
        z = self.bias + shares(data) @ self.table
        n = len(self.families)
        p = np.exp(z[:n] - z[:n].max())
        p /= p.sum()
        f = int(p.argmax())
        langs = self.members[f]
        if len(langs) == 1:
            return langs[0], float(p[f])
        wins = {lang: [0, 0.0] for lang in langs}
        sure = {lang: 1.0 for lang in langs}
        for k, (own, a, b) in enumerate(self.pairs):
            if own != f:
                continue
            m = float(z[n + k])
            wins[a if m > 0 else b][0] += 1
            wins[a][1] += m
            wins[b][1] -= m
            q = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
            sure[a], sure[b] = min(sure[a], q), min(sure[b], 1 - q)
        best = max(sorted(langs), key=lambda lang: wins[lang])
        return best, float(min(1.0, max(0.0, p[f] * sure[best])))


def _softmax_regression(x: np.ndarray, y: np.ndarray, n: int, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], n), np.float32), np.zeros(n, np.float32)
    share = np.bincount(y, minlength=n) / len(y)
    weight = (1 / (n * share[y])).astype(np.float32)[:, None]
    one = np.eye(n, dtype=np.float32)[y]
    mw = np.zeros_like(w)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = weight * (p - one) / len(y)
        mw = np.float32(0.9) * mw + x.T @ g + np.float32(1e-5) * w
        w -= 1.0 * mw
        b -= 1.0 * g.sum(axis=0)
    return w, b


def _linear_svm(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Squared hinge loss with a ridge, both classes weighted alike; y is +1 or -1."""
    w, b, m = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32)
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)).astype(np.float32)
    y = y.astype(np.float32)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ w + np.float32(b)))
        g = np.float32(-2 / len(y)) * weight * y * slack
        m = np.float32(0.9) * m + x.T @ g + np.float32(1e-4) * w
        w -= np.float32(0.1) * m
        b -= 0.1 * float(g.sum())
    return w, b


def fit(docs: DataFrame) -> Hierarchy:
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", 3, 1) & (F.length("text") <= MAX_FIT_CHARS))
    picked = bounded_sample(known.select("doc_id", "lang", utf8()), "lang", PER_LANG, "doc_id")
    rows = sorted((r["lang"], bytes(r["text"])) for r in picked.select("lang", "text").toLocalIterator())
    rows = [(lang, t) for lang, t in rows if has_letter(t)]
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Hierarchy([], [])
    by_family: dict[str, list[str]] = {}
    for lang in langs:
        by_family.setdefault(_FAMILY.get(lang, lang), []).append(lang)
    families = sorted(by_family)
    model = Hierarchy(families, [by_family[f] for f in families])
    size = 1 << BITS
    x = np.zeros((len(rows), size), np.float32)
    for k, (_, text) in enumerate(rows):
        x[k] = shares(text)
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5).astype(np.float32)
    x *= scale
    norm = 1 / max(1e-9, float(np.sqrt((x * x).sum(axis=1).mean())))
    x *= np.float32(norm)
    of = np.array([families.index(_FAMILY.get(lang, lang)) for lang, _ in rows])
    lang = np.array([lang for lang, _ in rows])
    weights, bias = [], []
    if len(families) > 1:
        w, b = _softmax_regression(x, of, len(families))
    else:
        w, b = np.zeros((size, 1)), np.zeros(1)
    weights.append(w)
    bias.append(b)
    for f, members in enumerate(model.members):
        for a, c in itertools.combinations(members, 2):
            pick = (lang == a) | (lang == c)
            w, b = _linear_svm(x[pick], np.where(lang[pick] == a, 1.0, -1.0))
            model.pairs.append((f, a, c))
            weights.append(w[:, None])
            bias.append(np.array([b]))
    model.table = (np.concatenate(weights, axis=1) * scale[:, None] * norm).astype(np.float32)
    model.bias = np.concatenate(bias)
    return model


def _predictor(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model.value.predict
        for batch in slices(batches):
            found = [predict(data.as_py()) for data in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return rows


def predict_languages(docs: DataFrame, model: Hierarchy | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # 8,192 buckets by families and pairs
    rows = docs.select("doc_id", utf8())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predictor(model), f"doc_id {kind}, lang_pred string, score double")
