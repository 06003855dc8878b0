"""Hashes of the words of a text and of runs of words, computed on whole byte arrays."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: ASCII white space separates words; A-Z count as a-z.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK_BYTES = re.compile(rb"[\x20\x09-\x0D]")
#: Odd, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once; a block ends with a word.
BLOCK = 1 << 20


def folded(text: str | None) -> list[bytes]:
    """The words of a text as they are compared."""
    return (text or "").encode().translate(_LOWER_BYTES).split()


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^(n - 1) modulo 2^64, and their inverses."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(4096, 1 << (n - 1).bit_length()))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit integer over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _run_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of every run the sum of value * base^place, places counted from the run's start."""
    up, down = _tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word, in order."""
    data, out, at = (text or "").encode(), [], 0
    while at < len(data):
        gap = _BLANK_BYTES.search(data, at + BLOCK)
        end = gap.start() if gap else len(data)
        raw = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~_BLANK[raw]
        edges = np.flatnonzero(np.diff(inside))
        out.append(_run_sums(_LOWER[raw], edges[::2], edges[1::2]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of size words, from the words' hashes; empty if there are fewer."""
    n = len(words) - size + 1
    return _run_sums(words, np.arange(n), np.arange(size, n + size)) if n > 0 else np.empty(0, np.uint64)
