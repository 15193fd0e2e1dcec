"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

WORDS = 5
#: Odd, so that it has an inverse modulo 2**64 (arbitrary, as are the other multipliers).
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)
STEPS = np.array([0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """For every code point that belongs to words (letters, digits and other numerals) its lower case, else 0."""
    lower = (chr(c).lower() for c in range(sys.maxunicode + 1))
    return np.fromiter((ord(x) if len(x) == 1 and x.isalnum() else 0 for x in lower), dtype=np.uint32, count=sys.maxunicode + 1)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i under n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def _words(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of each word among ``signs``, in order."""
    inside = np.zeros(len(signs) + 2, dtype=bool)
    np.not_equal(signs, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(signs) + 1)
    total = np.zeros(len(signs) + 1, dtype=np.uint64)
    np.cumsum(np.multiply(signs, up[: len(signs)], dtype=np.uint64), out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts]), starts


@lru_cache(maxsize=1)
def _folded_bytes() -> bytes:
    """``folded`` of the code points under 256, whose lower case is under 256, too."""
    return folded()[:256].astype(np.uint8).tobytes()


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the lower-cased text, and those ``folded``. In bytes where that is enough."""
    try:
        data = text.encode("latin-1")
        return np.frombuffer(data, dtype=np.uint8), np.frombuffer(data.translate(_folded_bytes()), dtype=np.uint8)
    except UnicodeEncodeError:
        pass
    if "\u0130" in text or "\u03a3" in text:  # their lower case is two signs, or depends on the place
        text = text.lower()
    cp = np.frombuffer(text.encode("utf-32-le", errors="replace"), dtype=np.uint32)
    return cp, folded()[cp]


def words(text: str) -> np.ndarray:
    """The hash of each word of the lower-cased text, in order."""
    return _words(_codes(text)[1])[0]


def word_starts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the number of the line (from 0, ended by line feeds) that it stands in."""
    cp, signs = _codes(text)
    found, starts = _words(signs)
    cuts = np.searchsorted(starts, np.flatnonzero(cp == 10))
    return found, np.repeat(np.arange(len(cuts) + 1), np.diff(np.r_[0, cuts, len(starts)]))


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """The hash of each run of ``size`` words, in order; a shorter text has one shingle of all its words, if any."""
    w = words(text)
    if not len(w):
        return w
    n = min(size, len(w))
    out = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ w[i : len(w) - n + 1 + i]) * STEPS[i % len(STEPS)] + np.uint64(i)
    return mixed(out)
