"""64-bit word hashes with a bounded cache."""

from __future__ import annotations

import numpy as np
import xxhash


class WordHash(dict):
    """Maps a word (bytes) to its 64-bit xxHash.  Misses are computed; the
    cache is emptied when it holds ``limit`` words, which bounds its memory."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising step of a 64-bit hash (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word windows; of a shorter, not
    empty sequence the whole as one."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    size = len(hashes) - n + 1
    x = np.full(size, np.uint64(n))
    for i in range(n):
        x = mix(x * np.uint64(0x9DDFEA08EB382D69) + hashes[i:i + size])
    return np.unique(x)
