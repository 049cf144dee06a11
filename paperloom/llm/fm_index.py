"""FM-index of a text of words, with a wavelet tree over its Burrows-Wheeler transform.

Suffixes are sorted by their first ``depth`` words, which serves patterns of no more words. The
tree has one bit vector a level, packed in 64-bit words with a running count for each; both ends of an
interval cost one count a level. All patterns step backwards together.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16
_ONE, _63 = np.uint64(1), np.uint64(63)


class Bits:
    """A bit vector with rank: 64 bits a word and a 32-bit running count for each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.uint32)
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        k = i >> 6
        low = (_ONE << (i.astype(np.uint64) & _63)) - _ONE
        return self.before[k].astype(np.int64) + np.bitwise_count(self.words[k] & low)


class Index:
    """Index of ``words`` (numbers from 1, 0 between passages); ``owners`` has the owner of each place.

    Suffixes are sorted by ``depth`` words, so patterns of at most so many are served. It keeps the bit vectors, where
    each word's suffixes start, and one small number a suffix for its owner: neither text nor suffix array.
    """

    def __init__(self, words: np.ndarray, owners: np.ndarray, depth: int = DEPTH):
        n = len(words)
        rank = words.astype(np.int64)
        order, step = np.argsort(rank, kind="stable"), 1
        while step < depth:
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - step)] = rank[step:] + 1
            key = rank * (int(follow.max(initial=0)) + 1) + follow
            order = np.argsort(key)
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank[order] = new
            step *= 2
        self.n = n
        top = int(words.max()) + 1 if n else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=top))]).astype(np.int64)
        left = words[order - 1]
        self.levels = []
        for bit in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            ones = ((left >> bit) & 1).astype(np.uint8)
            self.levels.append((bit, Bits(ones)))
            left = np.concatenate([left[ones == 0], left[ones == 1]])
        self.foot = self._down(np.arange(top), np.zeros(top, np.int64))
        self.names, place = np.unique(owners, return_inverse=True)
        self.owner = place[order].astype(np.min_scalar_type(max(1, len(self.names))))

    def _down(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place ``at`` of the transform falls at the tree's foot, for each word."""
        for bit, bits in self.levels:
            ones = bits.rank(at)
            at = np.where((word >> bit) & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each word before place i of the transform."""
        return self._down(word, i) - self.foot[word]

    def back(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more word in front."""
        both = self.rank(np.concatenate([word, word]), np.concatenate([lo, hi]))
        head = self.first[word]
        return head + both[: len(word)], head + both[len(word) :]

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least owner within each interval; none may be empty.

        Each different interval is read once. Intervals of patterns of one length are disjoint or the same, so for these
        the work is at most the index's size.
        """
        if not len(lo):
            return np.zeros(0, np.int64)
        each, place = np.unique(np.stack([lo, hi], axis=1), axis=0, return_inverse=True)
        padded = np.append(self.owner, self.owner[-1:])
        return self.names[np.minimum.reduceat(padded, each.ravel())[::2]][place.ravel()]


def matching_statistics(index: Index, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each end (exclusive) in ``text``: the longest match, up to ``most`` words, that ends there, and its interval.

    Word number 0, and numbers that the index does not have, match nothing.
    """
    lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), index.n, np.int64)
    length = np.zeros(len(ends), np.int64)
    live = np.arange(len(ends))
    known = len(index.first) - 1
    for k in range(1, most + 1):
        at = ends[live] - k
        live = live[at >= 0]
        word = text[ends[live] - k]
        good = (word > 0) & (word < known)
        live, word = live[good], word[good]
        if k == 1:
            a, b = index.first[word], index.first[word + 1]
        else:
            a, b = index.back(word, lo[live], hi[live])
        good = b > a
        live, a, b = live[good], a[good], b[good]
        lo[live], hi[live], length[live] = a, b, k
    return length, lo, hi
