"""Words and word shingles of UTF-8 texts as 64-bit hashes, computed for many texts at once with numpy.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A word's hash is a polynomial over
random byte codes, taken from prefix sums, and finished by a bit mixer.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20_011)
_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT = _CODE.copy()
_CODE[65:91] = _CODE[97:123]
_BASE = 0x9E3779B97F4A7C15
_STEP = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            row = np.full(n + n // 4, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray, fold: bool = True) -> np.ndarray:
    """``s`` such that ``spans(s, a, b)`` is a hash of ``data[a:b]``; ``fold`` takes A-Z as a-z."""
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_CODE if fold else _EXACT)[data] * powers(len(data))[0], out=total[1:])
    return total


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 offsets of each text's words."""
    is_word = ~_SPACE[data]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edges] = is_word[edges]
    last[edges - 1] = is_word[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, of_text = word_bounds(data, offsets)
    return spans(prefix_sums(data), starts, ends), of_text


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's distinct ``n``-word shingles, sorted; a shorter text is one shingle, one without words none."""
    words, of_text = word_hashes(data, offsets)
    runs = max(0, len(words) - n + 1)
    mix = np.zeros(runs, np.uint64)
    for k in range(n):
        mix += words[k : k + runs] * _STEP[k]
    mix = mixed(mix)
    out = []
    for a, b in zip(of_text[:-1], of_text[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(mix[a : b - n + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _STEP[: b - a]).sum(keepdims=True, dtype=np.uint64) + _STEP[32 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
