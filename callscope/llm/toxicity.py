"""Toxicity by a convolutional text classifier.

Words are hashed to embeddings: a word's is the mean of those of the word itself
and of its beginnings of a few lengths that have one, so words that share a stem
share what is learned about it. Filters of several widths run over the word
sequence, each is max-pooled over the whole text, and a logistic layer gives a
score. All is trained in numpy, with weight decay, until the texts that are held
back for calibration don't gain any more. The embeddings start from the smoothed
log-odds in the training sample beside small random values. Thresholds are
calibrated for each language that the text itself shows by its function words,
and shifted into the score so that 0.5 is the decision in all of them.

Fitted on a bounded sample (``PER_CLASS`` labelled rows a class, of those with
texts of up to ``MAX_FIT_CHARS``); only words and beginnings in ``MIN_DOCS`` of its
texts have an embedding of their own, at most ``MAX_WORDS`` of them.

Defined results: null and empty texts are scored as a text of unknown words;
without labelled rows of both kinds every score is 0; a document whose labels
contradict each other has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callscope.llm.common import labelled_sample, slices, utf8, word_hashes

PER_CLASS, MAX_FIT_CHARS, MIN_DOCS, MAX_WORDS = 2_500, 12_000, 4, 1 << 13
DIM, FILTERS, WIDTHS, EPOCHS, BATCH, DECAY = 12, 6, (1, 2, 3), 8, 64, 1e-3
#: Characters of the beginnings of words that have embeddings beside the words.
STEMS = (3, 4, 5, 6, 7)

#: Function words that show a language.
FUNCTION_WORDS = {
    "en": "the of and to in is that was for with",
    "de": "der die das und ist nicht ein den von zu",
    "fr": "le les des et est une dans du que pour",
    "es": "el los las y es una por del que con",
    "it": "il di che non per una sono della con gli",
    "pt": "o os as e um uma para com não do",
    "nl": "het een van en niet dat zijn op te voor",
}
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_LANGS = sorted(FUNCTION_WORDS)


def _cues() -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((int(h), k) for k, lang in enumerate(_LANGS) for h in word_hashes([w.encode() for w in FUNCTION_WORDS[lang].split()]))
    return np.array([h for h, _ in rows], np.uint64), np.array([k for _, k in rows])


_CUE_HASH, _CUE_LANG = _cues()
_FIRST = np.unique(_CUE_HASH, return_index=True)


def text_words(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_FOLD).split()


def word_features(words: list[bytes]) -> np.ndarray:
    """(words, 1 + stems) hashes of each word and of its longer beginnings; 0 for a beginning that isn't shorter than the word."""
    texts = [w.decode("utf-8", "ignore") for w in words]
    out = np.zeros((len(words), 1 + len(STEMS)), np.uint64)
    out[:, 0] = word_hashes(words)
    for k, n in enumerate(STEMS):
        at = [i for i, t in enumerate(texts) if len(t) > n]
        if at:
            out[at, k + 1] = word_hashes([texts[i][:n].encode() + b" *" for i in at])
    return out


@dataclass
class Texts:
    """Some texts: the features of their distinct words, and each text as places among them."""

    hashes: np.ndarray
    places: list[np.ndarray]
    words: list[list[bytes]]

    @classmethod
    def of(cls, texts: list[list[bytes]]) -> Texts:
        number: dict[bytes, int] = {}
        places = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in texts]
        return cls(word_features(list(number)), places, texts)


def shown_language(hashes: np.ndarray) -> int:
    """Place in ``_LANGS`` of the language with most function words; -1 if none is shown."""
    if not len(hashes):
        return -1
    hit = hashes[np.isin(hashes, _FIRST[0])]
    if not len(hit):
        return -1
    votes = np.zeros(len(_LANGS))
    lo, hi = np.searchsorted(_CUE_HASH, hit), np.searchsorted(_CUE_HASH, hit, side="right")
    for k in range(int((hi - lo).max())):
        own = lo + k < hi
        votes += np.bincount(_CUE_LANG[(lo + k)[own]], minlength=len(_LANGS))
    return int(votes.argmax())


@dataclass
class ConvModel:
    words: np.ndarray = None  # sorted hashes of the words and beginnings with embeddings
    embed: np.ndarray = None  # row 0, of no word, is 0
    conv: list[np.ndarray] = field(default_factory=list)  # by width: (width, DIM, FILTERS)
    shift: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = None
    bias: float = 0.0
    cut: np.ndarray = None  # logit of the threshold by language, the last for none

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The rows of the embeddings of features; 0 for one without."""
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, at + 1, 0)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        """Of each distinct word the mean of its features' embeddings; the last row is that of no word."""
        sums = self.embed[ids].sum(axis=1) / np.maximum(1, (ids > 0).sum(axis=1))[:, None]
        return np.concatenate([sums, np.zeros((1, sums.shape[1]), sums.dtype)])

    def tables(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        """What each word adds to each filter at each place: a convolution is then a sum of look-ups."""
        return [[vectors @ w[o] for o in range(len(w))] for w in self.conv]

    @staticmethod
    def padded(places: np.ndarray) -> np.ndarray:
        short = max(WIDTHS) - len(places)
        return np.concatenate([places, np.full(short, -1, np.int64)]) if short > 0 else places

    def pooled(self, places: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The filters' largest answers, before the bend at 0, and where they stand."""
        tops, values = [], []
        for table, shift in zip(tables, self.shift, strict=True):
            n = len(places) - len(table) + 1
            z = table[0][places[:n]]
            for o in range(1, len(table)):
                z = z + table[o][places[o : o + n]]
            top = z.argmax(axis=0)
            tops.append(top)
            values.append(z[top, np.arange(FILTERS)] + shift)
        return np.concatenate(values), tops

    def logits(self, texts: Texts) -> np.ndarray:
        tables = self.tables(self.vectors(self.ids(texts.hashes)))
        return np.array([float(np.maximum(self.pooled(self.padded(p), tables)[0], 0) @ self.out + self.bias) for p in texts.places])


def fit(docs: DataFrame, labels: DataFrame) -> ConvModel | None:
    sample = labelled_sample(docs, labels, "toxic", PER_CLASS, MAX_FIT_CHARS)
    sample = [(w, y) for w, y in ((text_words(t), y) for t, y in sample) if w]
    if len({y for _, y in sample}) < 2:
        return None
    return train(sample)


def _vocabulary(texts: Texts, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, log-odds) of the features that have an embedding: in enough texts, those that tell most."""
    distinct = [np.unique(texts.hashes[np.unique(p)]) for p in texts.places]
    found, where, count = np.unique(np.concatenate(distinct), return_inverse=True, return_counts=True)
    toxic = np.bincount(where, weights=np.repeat(y, [len(d) for d in distinct]))
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    odds = np.log((toxic / n1 + 4 / len(y)) / ((count - toxic) / n0 + 4 / len(y)))
    keep = np.flatnonzero((count >= min(MIN_DOCS, max(1, len(y) // 20))) & (found != 0))
    keep = np.sort(keep[np.argsort(-np.abs(odds[keep]), kind="stable")[:MAX_WORDS]])
    keep = keep if len(keep) else np.arange(1)
    return found[keep], np.clip(odds[keep], -4, 4)


def _started(words: np.ndarray, odds: np.ndarray, rng: np.random.RandomState) -> ConvModel:
    model = ConvModel(words=words)
    model.embed = rng.normal(0, 0.05, (len(words) + 1, DIM))
    model.embed[0] = 0
    model.embed[1:, 0] = odds
    for width in WIDTHS:
        w = rng.normal(0, 0.05, (width, DIM, FILTERS))
        w[:, 0, ::2] += 0.5 / width  # half of the filters start on the odds, half against them
        w[:, 0, 1::2] -= 0.5 / width
        model.conv.append(w)
        model.shift.append(np.zeros(FILTERS))
    k = FILTERS * len(WIDTHS)
    model.out = np.where(np.arange(k) % 2 == 0, 1.0, -0.3) / len(WIDTHS) * 0.8
    model.bias = -1.5
    return model


class _Adam:
    def __init__(self) -> None:
        self.state: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.step = 0

    def __call__(self, name: str, value: np.ndarray, grad: np.ndarray, rate: float) -> np.ndarray:
        m, v = self.state.get(name, (np.zeros_like(value), np.zeros_like(value)))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        self.state[name] = (m, v)
        return value - rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)


def _descend(model: ConvModel, texts: Texts, ids: np.ndarray, batch: np.ndarray, y: np.ndarray, weight: np.ndarray, adam: _Adam) -> None:
    """One step of gradient descent on the texts ``batch``."""
    adam.step += 1
    rows, flat_places = np.unique(np.concatenate([texts.places[d] for d in batch]), return_inverse=True)  # the words of these texts only
    places = np.split(flat_places, np.cumsum([len(texts.places[d]) for d in batch])[:-1])
    ids = ids[rows]
    known = np.maximum(1, (ids > 0).sum(axis=1))
    vectors = model.vectors(ids)
    tables = model.tables(vectors)
    g_embed, g_out, g_bias = np.zeros_like(model.embed), np.zeros_like(model.out), 0.0
    g_conv, g_shift = [np.zeros_like(w) for w in model.conv], [np.zeros(FILTERS) for _ in WIDTHS]
    for d, own in zip(batch, places, strict=True):
        own = model.padded(own)
        flat, tops = model.pooled(own, tables)
        act = np.maximum(flat, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.bias, -30, 30)))
        g = weight[d] * (p - y[d]) / len(batch)
        g_out += g * act
        g_bias += g
        g_flat = g * model.out * (flat > 0)
        for j, width in enumerate(WIDTHS):
            gf = g_flat[j * FILTERS : (j + 1) * FILTERS]
            g_shift[j] += gf
            for o in range(width):
                at = own[tops[j] + o]
                g_conv[j][o] += (vectors[at] * gf[:, None]).T
                real = at >= 0
                shares = gf[real, None] * model.conv[j][o].T[real] / known[at[real], None]
                np.add.at(g_embed, ids[at[real]], shares[:, None, :])
    g_embed[0] = 0
    model.embed = adam("e", model.embed, g_embed + DECAY / len(texts.places) * model.embed, 0.005)
    model.embed[0] = 0
    model.out = adam("o", model.out, g_out + DECAY * model.out, 0.01)
    model.bias = float(adam("b", np.array(model.bias), np.array(g_bias), 0.01))
    for j in range(len(WIDTHS)):
        model.conv[j] = adam(f"c{j}", model.conv[j], g_conv[j] + DECAY * model.conv[j], 0.005)
        model.shift[j] = adam(f"s{j}", model.shift[j], g_shift[j], 0.005)


def train(sample: list[tuple[list[bytes], int]], seed: int = 5) -> ConvModel:
    rng = np.random.RandomState(seed)
    y = np.array([label for _, label in sample], float)
    texts = Texts.of([words for words, _ in sample])
    # Every fifth text calibrates the thresholds and ends the training; the others train.
    held = np.arange(len(sample)) % 5 == 4 if len(sample) >= 50 else np.zeros(len(sample), bool)
    order = np.flatnonzero(~held)
    model = _started(*_vocabulary(Texts(texts.hashes, [texts.places[d] for d in order], []), y[order]), rng)
    ids = model.ids(texts.hashes)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    check = np.flatnonzero(held) if held.any() else order
    kept = Texts(texts.hashes, [texts.places[d] for d in check], [texts.words[d] for d in check])
    adam, best, state, waited = _Adam(), np.inf, None, 0
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            _descend(model, texts, ids, order[at : at + BATCH], y, weight, adam)
        z = np.clip(model.logits(kept), -30, 30)
        loss = float((weight[check] * (np.logaddexp(0, z) - y[check] * z)).mean())
        waited = 0 if loss < best else waited + 1
        if loss < best:
            best, state = loss, (model.embed.copy(), [w.copy() for w in model.conv], [s.copy() for s in model.shift], model.out.copy(), model.bias)
        if waited >= 3:
            break
    model.embed, model.conv, model.shift, model.out, model.bias = state
    z = model.logits(kept)
    lang = np.array([shown_language(word_hashes(words)) for words in kept.words])
    whole = _threshold(z, y[check], 0.0)
    model.cut = np.full(len(_LANGS) + 1, whole)
    for k in range(-1, len(_LANGS)):
        own = lang == k
        if own.sum() >= 30 and 0 < y[check][own].sum() < own.sum():
            model.cut[k] = _threshold(z[own], y[check][own], whole)
    model.embed = model.embed.astype(np.float32)
    model.conv = [w.astype(np.float32) for w in model.conv]
    model.shift = [s.astype(np.float32) for s in model.shift]
    return model


def _threshold(z: np.ndarray, y: np.ndarray, prior: float) -> float:
    """The logit with the best balanced accuracy; of equal ones the middle of those nearest to ``prior``."""
    order = np.sort(np.unique(z))
    cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
    good = np.array([((z >= c) & (y == 1)).sum() / max(1, (y == 1).sum()) + ((z < c) & (y == 0)).sum() / max(1, (y == 0).sum()) for c in cuts])
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float(cuts[best[np.abs(cuts[best] - prior).argmin()]])


def _scorer(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches):
            if m is None:
                scores = np.zeros(batch.num_rows)
            else:
                texts = Texts.of([text_words(data.as_py()) for data in batch.column("text")])
                z = m.logits(texts) - m.cut[[shown_language(texts.hashes[p, 0]) for p in texts.places]]
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ConvModel | None = None) -> DataFrame:
    """(doc_id, score) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))  # at most MAX_WORDS embeddings
    rows = docs.select("doc_id", utf8())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model), f"doc_id {kind}, score double")
