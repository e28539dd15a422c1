"""Words, lines and n-grams of many texts at once, as numpy arrays over their joined bytes."""

from __future__ import annotations

import numpy as np

#: What parts words: space, and tab to carriage return. Other white space is part of words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
#: Lower case for A to Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands."""
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of `inside`, cut at the texts' bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, closes = np.empty(n, bool), np.empty(n, bool)
    opens[0] = closes[-1] = True
    np.logical_not(inside[:-1], out=opens[1:])
    np.logical_not(inside[1:], out=closes[:-1])
    opens[bounds[:-1][bounds[:-1] < n]] = True
    closes[bounds[1:][bounds[1:] > 0] - 1] = True
    return np.flatnonzero(opens & inside), np.flatnonzero(closes & inside) + 1


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): text i has the words first[i] to first[i + 1]."""
    starts, ends = spans(~IS_SPACE[data], bounds)
    return starts, ends, np.searchsorted(starts, bounds)


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each item, from each text's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each text's values; 0 without any."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of each run of n words inside one text; the position is its first word's."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    joined = hashes[:count].copy()
    for i in range(1, n):
        joined *= np.uint64(0xD6E8FEB86659FD93)
        joined += hashes[i : i + count]
    last = np.repeat(first[1:] - n, np.diff(first))[:count]  # the last word of its text that begins one
    at = np.flatnonzero(np.arange(count) <= last)
    return mix(joined[at]), at


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles of n words, A-Z lower-cased, as sorted hashes.

    A text of fewer words has its whole sequence as its one shingle; one without words, none.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, bounds)
    hashes = span_hashes(data, starts, ends)
    joined, at = windows(hashes, first, n)
    cut = np.searchsorted(at, first)
    out = []
    for i in range(len(bounds) - 1):
        words = first[i + 1] - first[i]
        if words >= n:
            out.append(np.unique(joined[cut[i] : cut[i + 1]]))
        elif words:
            whole = np.full(1, words, np.uint64)
            for at_word in range(first[i], first[i + 1]):
                whole = mix(whole * np.uint64(0xA0761D6478BD642F) + hashes[at_word : at_word + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
