"""Words of a text as numbers, for one text at a time inside tasks.

A word's number is a polynomial in its UTF-8 bytes modulo 2**64, mixed; two different words get the
same one with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, _INVERSE)):
            grown = np.full(2 * n, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.cumprod(grown)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of MurmurHash3, public domain)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in an array of bytes; blanks are 0x20 and 0x09 to 0x0D."""
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def word_numbers(text: str | None, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Numbers, starts and ends of a text's words, and its bytes; ``lower`` lower-cases A to Z first."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    if lower:
        b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    start, end = spans(b)
    up, down = powers(len(b) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
    return mixed((total[end] - total[start]) * down[start]), start, end, raw


def windows(numbers: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n words."""
    if len(numbers) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(numbers) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + numbers[k : k + len(out)]
    return mixed(out)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Ascending distinct numbers of a text's n-word shingles; a shorter text is one shingle, one without words none."""
    numbers, *_ = word_numbers(text, lower=True)
    if not len(numbers):
        return np.zeros(0, np.uint64)
    return np.unique(windows(numbers, min(n, len(numbers))) + np.uint64(len(numbers) if len(numbers) < n else 0))
