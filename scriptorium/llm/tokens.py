"""Whole-text token ids, memoised by word.

``WordEncoder`` gives exactly the ids that the tokenizer file gives for a whole text. A
word-level BPE drops white space before it merges, so a text's ids are the ids of its
white-space separated words in order; each distinct word is therefore encoded once per
worker and looked up afterwards. Anything that could make the two differ (control
separators that only Python calls white space, a tokenizer that keeps white space) takes the
plain path through the library.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np

from .scratch import MEMO_WORDS

#: Python's str.split() breaks at these, the tokenizer's white-space class does not.
_PYTHON_ONLY_SPACES = "\x1c\x1d\x1e\x1f"
_TRAILING = frozenset(".,;:!?")
#: Words that the library encodes at a time.
LEARN_WORDS = 4096


def default_tokenizer() -> str:
    """Path of the word-level BPE vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encode texts to little-endian ids (two bytes each if the vocabulary allows, else four).

    Null and empty texts give only the end id. ``max_words`` bounds the memo of words,
    which learns no more when full. That changes the speed and never the ids.
    """

    def __init__(self, path: str | None = None, end_id: int = 1, max_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path or default_tokenizer())
        size = self._lib.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4")
        self._end = np.array([end_id], self.dtype).tobytes()
        self._max = max_words
        self._memo: dict[str, bytes] = {}
        self._ends_word = np.zeros(size, bool)
        for token, i in self._lib.get_vocab(with_added_tokens=False).items():
            self._ends_word[i] = token.endswith("</w>")
        #: Words are independent only where white space separates them and is dropped.
        self._by_word = self._ids("a b") == self._ids("a") + self._ids("b") and self._ids("A") == self._ids("a")

    def _ids(self, text: str) -> bytes:
        return self._pack(self._lib.encode(text, add_special_tokens=False).ids)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _words(self, text: str) -> list[str] | None:
        if not self._by_word or any(c in text for c in _PYTHON_ONLY_SPACES):
            return None
        try:
            text.encode("latin-1")  # there, lower-casing is per character and composition changes nothing
            return text.lower().split()
        except UnicodeEncodeError:
            return text.split()

    def _learned(self, words: set[str]) -> dict[str, bytes]:
        """Ids of ``words``, none of which is in the memo, and of what they are without a punctuation mark."""
        memo, new = self._memo, {}
        whole = {w for w in words if w.isalpha() and (w.isascii() or max(w) <= "ÿ")}
        rest = words - whole
        tailed = [w for w in rest if w[-1] in _TRAILING and (stem := w[:-1]).isalpha() and (stem.isascii() or max(stem) <= "ÿ")]
        odd = list(rest.difference(tailed))
        whole.update(stem for w in tailed if (stem := w[:-1]) not in memo)
        every = list(whole)
        for a in range(0, len(every), LEARN_WORDS):
            listed = every[a : a + LEARN_WORDS]
            ids = np.array(self._lib.encode_batch_fast([" ".join(listed)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self._ends_word[ids]) + 1 if len(ids) else ids
            if len(ends) == len(listed) and ends[-1] == len(ids):
                raw, k, at = ids.astype(self.dtype).tobytes(), self.dtype.itemsize, 0
                for w, e in zip(listed, (ends * k).tolist()):
                    new[w] = raw[at:e]
                    at = e
            else:
                odd += listed
        for a in range(0, len(odd), LEARN_WORDS):
            listed = odd[a : a + LEARN_WORDS]
            for w, e in zip(listed, self._lib.encode_batch_fast(listed, add_special_tokens=False)):
                new[w] = self._pack(e.ids)
        tails = {c: self._ids(c) for c in {w[-1] for w in tailed}}
        for w in tailed:
            stem = w[:-1]
            new[w] = (new[stem] if stem in new else memo[stem]) + tails[w[-1]]
        return new

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text and the end id, as bytes."""
        texts = list(texts)
        memo, parts = self._memo, [None if t is None else self._words(t) for t in texts]
        missing: set[str] = set()
        for p in parts:
            if p:
                missing.update(p)
        missing.difference_update(memo)
        new, before = self._learned(missing), len(memo)
        memo.update(new)
        get = memo.__getitem__
        out = [
            b"".join(map(get, p)) + self._end if p is not None else self._ids(t or "") + self._end
            for t, p in zip(texts, parts)
        ]
        for w in list(new)[max(0, self._max - before) :]:
            del memo[w]
        return out

    def forget(self) -> None:
        """Empty the memo."""
        self._memo.clear()

    def wide(self, ids: bytes) -> bytes:
        """The same ids as little-endian unsigned 32-bit integers."""
        return np.frombuffer(ids, self.dtype).astype("<u4").tobytes()


def crc32_u32(ids: bytes, dtype: np.dtype) -> int:
    """Unsigned CRC-32 over ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, dtype).astype("<u4"))


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str | None, end_id: int, max_words: int = MEMO_WORDS) -> WordEncoder:
    """The worker process's one encoder, which outlives a task: some 40 MB for the vocabulary and 200 bytes a word of its memo."""
    key = (path, end_id, max_words)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(path, end_id, max_words)
    return _ENCODERS[key]
