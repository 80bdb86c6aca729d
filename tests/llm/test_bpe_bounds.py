"""Long texts go through several tries, and what is remembered stays within its bound."""

import hashlib
import struct

import public_tokenizers
from tokenizers import Tokenizer

from callscope.llm import bpe, queries


def test_long_texts_and_a_small_memory(monkeypatch):
    path = public_tokenizers.path(queries.TOKENIZER)
    for name, value in (("TRIE_WORDS", 7), ("WHOLE_CHARS", 40), ("MEMO_BYTES", 2_000), ("MAX_PAIRS", 20)):
        monkeypatch.setattr(bpe, name, value)
    texts = ["", "a", " ".join(f"word{k % 50} \u00fcber{k}" for k in range(400)), "x<|endoftext|> y " * 30, "one two three four five six seven", "tail"]
    coder = bpe.DocumentCoder(bpe.Vocabulary(path), public_tokenizers.PATTERN)
    tokenizer = Tokenizer.from_file(path)
    for text, (n, ids_sha, decoded_sha, ids) in zip(texts, coder.code(texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        data = struct.pack(f"<{len(want)}I", *want)
        assert (n, ids, ids_sha) == (len(want), data, hashlib.sha256(data).hexdigest())
        assert decoded_sha == hashlib.sha256(tokenizer.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert coder.encoder.size < 2_000 + 8 * (bpe.WORD_BYTES + 80)
