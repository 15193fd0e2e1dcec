"""Hashed character n-grams of whole texts, in numpy: shared by language identification and toxicity."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

#: Odd multipliers, one for each place in an n-gram and one for each n (arbitrary, but part of every trained model).
PLACES = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 2484345967], dtype=np.uint32)
LENGTHS = np.array([0, 2221713035, 1103515245, 2891336453, 747796405, 3406940213, 1181783497], dtype=np.uint32)
SPACE = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def codes(text: str) -> np.ndarray:
    """Lower-cased code points; each run of other signs than letters is one space, with a space at both ends."""
    cp = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", errors="replace"), dtype=np.uint32)
    letter = letters()[cp]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first sign after a letter stands for the run
    return np.where(letter, cp, SPACE).astype(np.uint32)[keep]


def hashed(cp: np.ndarray, lengths: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each n the bucket, 0 to 2**bits - 1, of each n-gram of ``cp``, in order."""
    out, total, shift = [], None, np.uint32(32 - bits)
    for n in range(1, max(lengths) + 1):
        if len(cp) < n:
            break
        part = cp[n - 1 :] * PLACES[n - 1]
        total = part if total is None else total[: len(part)] + part
        if n in lengths:
            mixed = total ^ (total >> np.uint32(15))
            out.append((mixed * LENGTHS[n]) >> shift)
    return out
