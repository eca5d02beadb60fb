"""Word shingles of whole texts as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of other than ASCII white space, with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``size``-word shingles; with fewer words, of all its words as one; without
    words, none. Two different shingles share a hash with a chance of 2**-64."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = max(1, len(w) - size + 1)
    width = min(size, len(w))
    h = np.full(n, np.uint64(width))
    for i in range(width):
        h = mixed(h * _MULTIPLIER + w[i : i + n])
    return np.unique(h)


def set_key(hashes: np.ndarray) -> bytes:
    """A 192-bit digest of a set of hashes: equal sets have equal keys."""
    return np.array([len(hashes), mixed(hashes).sum(dtype=np.uint64), mixed(hashes ^ _MULTIPLIER).sum(dtype=np.uint64)], np.uint64).tobytes()
