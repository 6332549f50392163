"""Words and shingles as numbers.

Words are runs without the six ASCII white-space characters, which is what
``bytes.split()`` yields; ``bytes.lower()`` lower-cases A-Z alone.
"""

from __future__ import annotations

import numpy as np
import xxhash

_mix = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _mix[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _mix[1]
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(size, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = finish(total + h[i:len(h) - n + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    if n < size:  # a short text's sequence is no n-gram of a longer one
        total = finish(total + np.uint64(n))
    return np.unique(total)
