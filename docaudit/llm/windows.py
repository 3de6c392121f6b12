"""Sampled suffixes of byte texts: which position stands for each window, found for whole texts with numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEVEL = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of a position within a block; the rest of the 64 order the sampled hashes.
POS = 30
BLOCK = 1 << 24


def doubled(data: np.ndarray, level: int, h: np.ndarray | None = None, done: int = 0) -> np.ndarray:
    """Hash of the 2**level bytes at each position of data (uint8), from that of 2**done bytes where it is given."""
    if h is None:
        h = _BYTE[data]
    for k in range(done, level):
        step = 1 << k
        if len(h) <= step:
            return np.empty(0, np.uint64)
        h = h[:-step] * _LEVEL[k] + (h[step:] ^ (h[step:] >> np.uint64(31)))
    return h


def final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    m, have = x, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


def segments(data: np.ndarray, window: int = 100, level: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, anchor, anchor hash, content hash) of the runs of windows that share a sampled position.

    Each window of `window` bytes is represented by that of its 2**level-byte substrings which has the smallest hash, the
    leftmost of equals; so equal windows have equal representatives at equal offsets. Windows next to each other mostly
    share theirs: such a run of windows is one segment of bytes, from the first window's start to the last one's end.
    """
    out = []
    size = 1 << level
    for base in range(0, max(len(data) - window + 1, 0), BLOCK):
        part = data[base : base + BLOCK + window - 1]
        h = doubled(part, level)
        mixed = final(h)
        keys = (mixed >> np.uint64(POS)) << np.uint64(POS) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(keys, window - size + 1) & np.uint64((1 << POS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        length = last - first + window
        wide = doubled(part, 6, h, level)
        ends = first + length - 64
        content = final(wide[first] * _LEVEL[8] + final(wide[(first + ends) // 2]) * _LEVEL[9] + final(wide[ends] ^ length.astype(np.uint64)))
        out.append((first + base, length, at[first] - first, mixed[at[first]], content))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
