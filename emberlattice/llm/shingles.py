"""Word and shingle fingerprints of whole texts, vectorised for use inside tasks."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]  # A-Z count as a-z
_BLOCK = 4096
_POWERS = _RNG.integers(0, 2**64, _BLOCK, dtype=np.uint64) | np.uint64(1)
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit fingerprint and the byte length of every word (between ASCII spaces), A-Z read as a-z."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = ~_GAP[data]
    if not inside.any():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    lengths = edge[1::2] - edge[::2]
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    terms = _TABLE[data[inside]] * _POWERS[place % _BLOCK]
    if lengths.max() > _BLOCK:
        terms = mix(terms + (place // _BLOCK).astype(np.uint64) * _A)
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _A), lengths


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct fingerprints of the text's word shingles; a shorter text is one shingle.

    The six highest bits fall with the shingle's length in bytes, so long shingles, which few texts
    share, come first in the order of fingerprints; the other 58 bits are the hash.
    """
    words, lengths = word_hashes(text) if text else (np.zeros(0, dtype=np.uint64), None)
    if not len(words):
        return words
    span = min(width, len(words))
    count = len(words) - span + 1
    out, size = np.full(count, span, dtype=np.uint64), np.zeros(count, dtype=np.int64)
    for k in range(span):
        out = mix(out * _A + words[k:k + count])
        size += lengths[k:k + count]
    rank = np.maximum(63 - size // 2, 0).astype(np.uint64)
    return np.unique((out >> np.uint64(6)) | (rank << np.uint64(58)))
