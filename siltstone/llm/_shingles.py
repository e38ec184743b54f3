"""Words and shingles of whole texts as 64-bit numbers (collisions are of the order of n^2 / 2^64)."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker remembers the hashes of; to hash one anew costs little more than to find it.
_CACHED = 100_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()
_PLACE = np.random.default_rng(1).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += words[i : i + n] * _PLACE[i]
    return mix(total)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a lower-cased text; a short text is one shingle, one without words has none."""
    words = word_hashes(text.lower().split())
    if 0 < len(words) < width:
        return mix((words * _PLACE[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    return np.unique(window_hashes(words, width))
