"""Word shingles as 64-bit hashes, computed inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WIDTH = 5
WORD = re.compile(r"\w+")
KEPT_WORDS = 300_000
_P, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of the word shingles of a text, in lower case. A text of fewer words than the width is one
    shingle; a text without words has none."""

    def __init__(self, width: int = WIDTH):
        self.width, self.kept = width, {}

    def _learn(self, word: str) -> int:
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        h = xxhash.xxh64_intdigest(word) or 1
        if len(word) <= 64:
            self.kept[word] = h
        return h

    def words(self, text: str) -> np.ndarray:
        known = self.kept.get
        return np.array([known(w) or self._learn(w) for w in WORD.findall(text.lower())], np.uint64)

    def read(self, text: str) -> np.ndarray:
        words = self.words(text)
        if not len(words):
            return words
        width = min(self.width, len(words))
        n = len(words) - width + 1
        total = words[:n].copy()
        for k in range(1, width):
            total = total * _P + words[k : k + n]
        return np.unique(mixed(total + np.uint64(width)))
