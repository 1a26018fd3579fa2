"""Words, their hashes and windows of them, vectorised over the UTF-8 bytes of many texts at once.

A word is a run of bytes other than space and U+0009 to U+000D. Those are all ASCII, so bytes will do; a word never
crosses from one text to the next.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20_240_601)
#: A random odd value for each byte, and the base of the polynomial hash (odd, so that it has an inverse).
_VALUE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        size = 1 << max(10, n - 1).bit_length()
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(factors)
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of h over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = the sum of values[k] * base**k for i <= k < j, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_table(_BASE, len(values)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], alike wherever they stand."""
    n = int(starts.max()) + 1 if len(starts) else 0
    return mixed((sums[ends] - sums[starts]) * _power_table(_INVERSE, n)[starts])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _VALUE[data]


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begin = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[begin] = inside[begin]
    last[begin[1:] - 1] = inside[begin[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(prefix_sums(byte_values(data)), starts, ends)


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` values; runs may cross texts, which the caller leaves out."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return range_hashes(prefix_sums(word_hashes), at, at + size)


def windows_within(first_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows that stay within a text, and the text of each."""
    counts = np.maximum(np.diff(first_word) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first_word[:-1], counts)
    return at, text


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n positions lie in [start, start + size) of some start."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + size, n), -1)
    return np.cumsum(steps[:-1]) > 0


def covered_bytes(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in [start, end) of some word; words do not overlap."""
    steps = np.zeros(n + 1, np.int8)
    steps[starts] += 1
    steps[ends] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8) > 0
