"""Words of a text, their 64-bit hashes, and the hashes of word shingles.

Words are runs of characters other than space and U+0009 to U+000D, with A-Z lower-cased. On the UTF-8 bytes that is exactly
bytes.lower() and bytes.split(), as both know ASCII only.
"""

from __future__ import annotations

import numpy as np

_SHIFT, _A, _B = np.uint64(31), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> _SHIFT)) * _B
    x = (x ^ (x >> _SHIFT)) * _A
    return x ^ (x >> _SHIFT)


_rng = np.random.default_rng(5)
#: A random number for each byte, white space 0, and an odd base: a word's hash is the sum of its bytes' numbers times powers of the base.
_BYTES = np.where(np.isin(np.arange(256), [32, *range(9, 14)]), 0, _rng.integers(1, 2**63, 256)).astype(np.uint64)
_SPACE = _BYTES == 0
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once.
BLOCK = 1 << 20


class Words:
    """Hashes of the words of a text, all at once and without a store of words."""

    def __init__(self) -> None:
        self._powers = np.ones(1, np.uint64)

    def _power(self, n: int) -> np.ndarray:
        if len(self._powers) < n:
            factors = np.full(max(n, 256), _BASE, np.uint64)
            factors[0] = 1
            self._powers = np.cumprod(factors, dtype=np.uint64)
        return self._powers

    def _block(self, raw: np.ndarray) -> np.ndarray:
        space = _SPACE[raw]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if not len(starts):
            return np.empty(0, np.uint64)
        raw = raw[starts[0] :]
        starts = starts - starts[0]
        size = np.diff(np.concatenate([starts, [len(raw)]]))  # with the white space that follows, which adds 0
        place = np.arange(len(raw)) - np.repeat(starts, size)
        return mixed(np.add.reduceat(_BYTES[raw] * self._power(int(size.max()))[place], starts))

    def hashes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode().lower(), np.uint8)
        if len(raw) <= BLOCK:
            return self._block(raw)
        gaps = np.flatnonzero(_SPACE[raw])
        cuts = np.unique(gaps[np.minimum(np.searchsorted(gaps, np.arange(BLOCK, len(raw), BLOCK)), len(gaps) - 1)]) if len(gaps) else []
        return np.concatenate([self._block(part) for part in np.split(raw, cuts)])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k words, in order; a text with fewer words is one run, a text without words none."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = words[: len(words) - k + 1]
    for i in range(1, k):
        out = mixed(out) + words[i : len(words) - k + 1 + i]
    return mixed(out + np.uint64(k))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingles(words, k))
