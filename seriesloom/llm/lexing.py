"""Words of whole Arrow batches as 64-bit hashes, without a Python object per word.

A word's hash is a polynomial over a random number per byte, taken from running
sums; blocks of bytes bound the memory of the sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_STEP = np.uint64(int(_RNG.integers(1, 2**62)) * 2 + 1)
_INVERSE = pow(_BASE, -1, 2**64)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACED = np.ones(256, bool)  # words between ASCII white space
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)  # runs of digits, letters and everything beyond ASCII
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(_INVERSE, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over their whole range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(text: bytes, gap: re.Pattern, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, each cut at the next ``gap`` so that no word is cut."""
    at = 0
    while len(text) - at > size:
        found = gap.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


@dataclass
class Words:
    """Words of a batch in order: byte spans, hash, and per text the first word (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    first: np.ndarray

    def texts(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts()), np.diff(self.first))


def words(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> Words:
    """Words are longest runs of bytes that ``inside`` marks, after lower-casing A-Z; none spans two texts."""
    folded = FOLD[data]
    mark = inside[folded]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    begin = mark.copy()
    begin[1:] &= ~mark[:-1] | cut[1:-1]
    stop = mark.copy()
    stop[:-1] &= ~mark[1:] | cut[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    value = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(int(np.searchsorted(end, base + BLOCK, "right")), i + 1)
        n = int(end[j - 1] - base)
        up, down = (_UP, _DOWN) if n <= BLOCK else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[folded[base : base + n]] * up[:n], out=total[1:])
        s, e = start[i:j] - base, end[i:j] - base
        value[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return Words(folded, start, end, mix(value), np.searchsorted(start, starts))


def windows(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``length`` words by its first word, and whether it lies in one text."""
    n = len(w.value) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total, factor = np.full(n, length, np.uint64), np.uint64(1)
    for k in range(length):
        total += w.value[k : k + n] * factor
        factor = np.uint64(int(factor) * int(_STEP) % 2**64)
    owner = w.owner()
    return mix(total), owner[:n] == owner[length - 1 :]


def shingle_sets(w: Words, length: int) -> list[np.ndarray]:
    """Per text the sorted set of its windows; a text of fewer words has its whole sequence as the only one."""
    value, whole = windows(w, length)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= length:
            out.append(np.unique(value[a : b - length + 1]))
        elif b > a:
            factors = _powers(int(_STEP), int(b - a))
            out.append(mix(np.atleast_1d((w.value[a:b] * factors).sum(dtype=np.uint64) + np.uint64(b - a))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
