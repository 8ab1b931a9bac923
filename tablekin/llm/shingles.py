"""Word shingles as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

from tablekin.llm.common import mix64

_MULTIPLIERS = mix64(np.arange(1, 65)) | np.uint64(1)


class WordHash(dict):
    """64-bit hash of a word, remembered for words met before; forgets all beyond ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` hashed words; fewer words, but not none, are one window."""
    n = len(words)
    size = min(size, n)
    if not n:
        return np.zeros(0, np.uint64)
    total = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        total += words[k : n - size + 1 + k] * _MULTIPLIERS[k]
    return mix64(total)


def shingle_set(text: bytes, hashes: WordHash, size: int) -> np.ndarray:
    """Sorted distinct shingles of the A-Z lower-cased words between ASCII white space."""
    return np.unique(window_hashes(hashes.of(text.lower().split()), size))
