"""Hashed word shingles, an Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHash(dict):
    """Hash of each word, remembered for up to so many words."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, known: WordHash, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; the whole sequence where it has fewer words; none without words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    g = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        g = mix(g * _A + h[k : len(h) - width + 1 + k])
    g.sort()
    return g[np.r_[True, g[1:] != g[:-1]]]
