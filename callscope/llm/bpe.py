"""BPE encoding and decoding by a prefix-sharing trie traversal.

The encoding of every prefix of a word ends in exactly one token: the suffix
token that, after the last token of the prefix before it, byte-pair merging
would leave standing. So one last token is the whole state of a prefix. The
distinct words of a batch, in byte order, are the depth-first order of their
trie: the path of last tokens up to the common prefix with the word before is
kept, and only the new nodes are computed. A word's encoding is read off by
stepping back from its last node. Decoding joins the bytes of the tokens.

Defined results: null and empty texts have no tokens. Special tokens written in
a text are encoded as such, as the tokenizer does by default.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import json
import re
import struct
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from callscope.llm.common import slices

#: Bytes (about) of remembered words, and how many token pairs are remembered, until a task starts afresh.
MEMO_BYTES, MAX_PAIRS = 40 << 20, 300_000
#: Bytes that a remembered word takes beside its letters and ids.
WORD_BYTES = 190
#: Words that are put into one trie.
TRIE_WORDS = 60_000
#: Characters of a text that is split as a whole; a longer one is split match by match.
WHOLE_CHARS = 200_000
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and the split of every merged token, from a tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, back = spec["model"], byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.ids = {bytes(back[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
        self.bytes = {k: b for b, k in self.ids.items()} | {k: s.encode() for s, k in special.items()}
        n = 1 + max(self.bytes, default=0)
        #: Of a merged token: the rank of its merge (else -1) and its two parts.
        self.rank, self.left, self.right = (array("i", [-1]) * n for _ in range(3))
        self.n = n
        self.merge: dict[int, int] = {}  # rank of a pair (a, b) by a * n + b
        for r, pair in enumerate(model["merges"]):
            a, b = (bytes(back[c] for c in t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.ids[a + b]
            self.merge[self.ids[a] * n + self.ids[b]] = r
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, self.ids[a], self.ids[b]
        #: Bytes of the longest token by its last three bytes; tokens without three are found anyway.
        self.longest: dict[bytes, int] = {}
        for b in self.ids:
            if len(b) > 2:
                self.longest[b[-3:]] = max(len(b), self.longest.get(b[-3:], 0))


class TrieEncoder:
    """Encodes sets of words; ``known`` maps a word to its ids as little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.size = 0
        self.pairs: dict[int, bool] = {}

    def stands(self, a: int, b: int) -> bool:
        """Whether merging leaves token ``a`` followed by token ``b`` as they are.

        Both are undone from the latest merge back; a merge across their border
        that ranks before the merge just undone would have come first.
        """
        rank, left, right, merge, n = self.v.rank, self.v.left, self.v.right, self.v.merge, self.v.n
        before = len(merge) + 1
        while True:
            across = merge.get(a * n + b)
            if across is not None and across < before:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, right[a]
            else:  # of equal merges the left one comes first
                before, b = rb + 1, left[b]

    def encode(self, words: Iterable[str]) -> None:
        """Adds the words to ``known``; what it held before may go."""
        words = set(words)
        if self.size > MEMO_BYTES:
            self.known = {w: self.known[w] for w in words if w in self.known}
            self.size = sum(len(w) + len(k) + WORD_BYTES for w, k in self.known.items())
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        ids, longest, pairs, known, token, n = self.v.ids, self.v.longest, self.pairs, self.known, self.v.bytes, self.v.n
        last: list[int] = [-1]  # by depth: the last token of the path's prefix
        before = b""
        for word, text in sorted([(w.encode(), w) for w in words if w not in known]):
            size, shared, most = len(word), 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, size + 1):
                start = end - longest.get(word[end - 3 : end], 2) if end > 2 else 0
                start = max(start, 0)
                while True:
                    t = ids.get(word[start:end])
                    if t is not None:
                        if not start:
                            break
                        a = last[start]
                        ok = pairs.get(a * n + t)
                        if ok is None:
                            ok = pairs[a * n + t] = self.stands(a, t)
                        if ok:
                            break
                    start += 1
                    if start == end:
                        raise ValueError(f"the vocabulary can't encode {word[:end]!r}")
                last.append(t)
            out, at = [], size
            while at:
                t = last[at]
                out.append(t)
                at -= len(token[t])
            out.reverse()
            known[text] = packed(out)
            self.size += size + 4 * len(out) + WORD_BYTES
            before = word


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _NATIVE else struct.pack(f"<{len(ids)}I", *ids)


def unpacked(data: bytes) -> Iterable[int]:
    return array("I", data) if _NATIVE else struct.unpack(f"<{len(data) // 4}I", data)


#: Letters from Latin-1 to the IPA extensions, and a character beyond them and plain ASCII.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af"
_NOT_PLAIN = re.compile(rf"[^\t-\r -~{_LETTERS}]").search


def splitter(pattern: str) -> Callable[[str], Iterable[str]]:
    """All matches of the tokenizer's pattern; texts of Latin letters take an equal pattern of the faster library."""
    full = regex.compile(pattern)
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTERS}0-9]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", "[0-9]")
    fast = full if r"\p" in plain else re.compile(plain)

    def split(text: str) -> Iterable[str]:
        own = full if _NOT_PLAIN(text) else fast
        return own.findall(text) if len(text) <= WHOLE_CHARS else (m[0] for m in own.finditer(text))

    return split


class DocumentCoder:
    """Encodes and decodes texts; the words of several short texts share a trie, a long text goes through several."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.encoder, self.split, self.token = TrieEncoder(vocabulary), splitter(pattern), vocabulary.bytes
        self.special = {s: packed([k]) for s, k in vocabulary.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, names))) if names else None

    def pieces(self, text: str) -> Iterable[str]:
        """Words and special tokens in turn; the latter keep their names."""
        if self.cut is None or not self.cut.search(text):
            return self.split(text)

        def parts() -> Iterator[str]:
            at = 0
            for m in self.cut.finditer(text):
                yield from self.split(text[at : m.start()])
                yield m[0]
                at = m.end()
            yield from self.split(text[at:])

        return parts()

    def code(self, texts: list[str]) -> Iterator[tuple[int, str, str, bytes]]:
        """(number of tokens, digest of the ids, digest of the decoded text, ids) of each text."""
        group: list[list[str]] = []
        n = 0
        for text in texts:
            words = iter(self.pieces(text))
            own = list(itertools.islice(words, TRIE_WORDS))
            if len(own) == TRIE_WORDS:
                yield from self._flush(group)
                group, n = [], 0
                yield self._coded(itertools.chain([own], iter(lambda w=words: list(itertools.islice(w, TRIE_WORDS)), [])))
                continue
            group.append(own)
            n += len(own)
            if n > TRIE_WORDS:
                yield from self._flush(group)
                group, n = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[list[str]]) -> Iterator[tuple[int, str, str, bytes]]:
        self._learn(itertools.chain.from_iterable(group))
        for words in group:
            yield self._coded([words], learn=False)

    def _learn(self, words: Iterable[str]) -> None:
        self.encoder.encode(set(words) - self.special.keys())
        self.encoder.known.update(self.special)

    def _coded(self, parts: Iterable[list[str]], learn: bool = True) -> tuple[int, str, str, bytes]:
        ids, decoded, data = hashlib.sha256(), hashlib.sha256(), []
        text = codecs.getincrementaldecoder("utf-8")("replace")
        for words in parts:
            if learn:
                self._learn(words)
            data.append(b"".join(map(self.encoder.known.__getitem__, words)))
            ids.update(data[-1])
            decoded.update(text.decode(b"".join(map(self.token.__getitem__, unpacked(data[-1])))).encode())
        decoded.update(text.decode(b"", True).encode())
        whole = b"".join(data) if len(data) != 1 else data[0]
        return len(whole) // 4, ids.hexdigest(), decoded.hexdigest(), whole


def _coder(vocabulary, pattern: str, want_ids: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = DocumentCoder(vocabulary.value, pattern)
        types = (pa.int64(), pa.string(), pa.string(), pa.binary())
        for batch in slices(batches):
            rows = list(coder.code([text.as_py() or "" for text in batch.column("text")]))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            columns[3] = columns[3] if want_ids else [None] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
            )

    return code


def encode_documents(docs: DataFrame, tokenizer_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``with_ids`` also the ids as little-endian 32-bit integers."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))  # as large as the vocabulary file
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_coder(vocabulary, pattern, with_ids), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    return out if with_ids else out.drop("ids")


def decode_ids(ids: bytes, vocabulary: Vocabulary) -> str:
    """The text of token ids given as little-endian 32-bit integers."""
    return b"".join(vocabulary.bytes[k] for k in struct.unpack(f"<{len(ids) // 4}I", ids)).decode("utf-8", "replace")
