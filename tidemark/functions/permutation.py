"""Keyed permutations of a range: draws without replacement that cost one step each, whatever the size of the range."""

from __future__ import annotations

import numpy as np


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix: each bit of the result depends on all bits of ``x``."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(places: np.ndarray, n: int, key: int, rounds: int = 10) -> np.ndarray:
    """Images of ``places`` in [0, n) under the permutation of ``key``.

    A balanced network over the next power of four, walked on while an image falls outside of the range: at most
    four times the range, so a few walks.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _mixed(np.array([(key * 64 + r) & 0xFFFFFFFFFFFFFFFF for r in range(rounds)], dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(rounds):
            left, right = right, left ^ (_mixed(right + keys[r]) & mask)
        return (left << np.uint64(half)) | right

    x = once(np.asarray(places, dtype=np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)
