"""Token ids of whole texts by a tokenizer file, word by word with a bounded cache."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

# Words that a Python worker remembers, about 200 bytes each, twice over while a new set fills.
CACHED_WORDS = 250_000
# ASCII punctuation after an ASCII letter, up to white space; not from an apostrophe on, which may belong to the letters.
# The class stands first, so that the search skips what is not in it.
_TRAILING = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)[!-/:-@\[-`{-~]*(?=[\x20\x09-\x0D]|\Z)")


class WordTokenizer:
    """Ids of a tokenizer that drops white space, lower-cases, and marks the last piece of a run of letters.

    No piece of such a tokenizer reaches over white space, or from a letter to the
    punctuation after it.  So the ids of a text are those of its parts in a row,
    and equal parts need encoding once.  New parts of letters alone are encoded
    together and told apart by their marked last pieces; if they have more or
    fewer than one each, all are encoded one by one.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        # Lower-case ASCII letters need no normalising: only white space is dropped before the merges.
        self._bare = Tokenizer(self._tokenizer.model)
        self._bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        suffix = described["model"].get("end_of_word_suffix")
        kinds = [part.get("type") for part in (described["normalizer"] or {}).get("normalizers", [])]
        if not suffix or "Lowercase" not in kinds:
            raise ValueError("needs a tokenizer that lower-cases and marks the ends of words")
        # Texts with the beginning of a special token are not lower-cased before.
        self._special = [token["content"][:2].encode() for token in described["added_tokens"]]
        vocabulary = self._tokenizer.get_vocab()
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        self._last[[number for piece, number in vocabulary.items() if piece.endswith(suffix)]] = True
        self._cached = cached
        self._recent: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text."""
        split = [self._parts(text.encode()) for text in texts]
        if len(self._recent) > self._cached:
            self._recent, self._older = {}, self._recent
        recent = self._recent
        self._learn(set().union(*split).difference(recent))
        return [np.frombuffer(b"".join(map(recent.__getitem__, parts)), "<u4") for parts in split]

    def _parts(self, text: bytes) -> list[bytes]:
        # On bytes, split() knows exactly the ASCII white space and lower() the ASCII letters.
        if any(begin in text for begin in self._special):
            return text.split()
        return _TRAILING.sub(rb" \g<0>", text.lower()).split()

    def _learn(self, parts: set[bytes]) -> None:
        recent, older = self._recent, self._older
        # Not parts.intersection(older), which goes through all of a dictionary.
        again = [part for part in parts if part in older]
        recent.update(zip(again, map(older.__getitem__, again)))
        plain, letters, others = [], [], []
        for part in parts.difference(again):
            if part.isalpha() and part.islower():
                plain.append(part)
            else:
                (letters if part.decode().isalpha() else others).append(part)
        recent.update(zip(plain, self._together(self._bare, plain)))
        recent.update(zip(letters, self._together(self._tokenizer, letters)))
        recent.update(zip(others, self._one_by_one(others)))

    def _together(self, tokenizer, words: list[bytes]) -> list[bytes]:
        joined = b" ".join(words).decode()
        ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self._last[ids]) + 1) * 4
        if len(ends) != len(words):
            return self._one_by_one(words)
        packed, cuts = ids.tobytes(), [0, *ends.tolist()]
        return [packed[start:end] for start, end in zip(cuts, cuts[1:])]

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast([word.decode() for word in words], add_special_tokens=False)
        return [np.array(one.ids, "<u4").tobytes() for one in found]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    return WordTokenizer(path)
