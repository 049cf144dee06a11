"""Bidirectional FM-index of a text of words: intervals of a phrase in the text and in its reverse, kept in step.

Suffixes are sorted by their first ``DEPTH`` words, which serves phrases of no more words. All phrases of one length are
extended together.
"""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

import numpy as np

from paperloom.llm.fm_index import Bits

DEPTH = 4


class Phrases(NamedTuple):
    """Phrases of one length: where their intervals start in the text's order and in the reverse's, and their occurrences."""

    forward: np.ndarray
    reverse: np.ndarray
    count: np.ndarray


def _sorted_suffixes(words: np.ndarray, top: int) -> np.ndarray:
    """Places in the order of their first DEPTH words, 0 after the end."""
    ahead = np.concatenate([words, np.zeros(DEPTH - 1, words.dtype)]).astype(np.uint64)
    part = [ahead[k : k + len(words)] for k in range(DEPTH)]
    if top <= 1 << 16:
        return np.argsort(part[0] << np.uint64(48) | part[1] << np.uint64(32) | part[2] << np.uint64(16) | part[3])  # equal ones in any order
    return np.lexsort((part[2] << np.uint64(32) | part[3], part[0] << np.uint64(32) | part[1]))


class Side:
    """A wavelet matrix over the Burrows-Wheeler transform of ``words`` (numbers below ``top``; 0 parts passages and stands at both ends)."""

    def __init__(self, words: np.ndarray, top: int):
        order = _sorted_suffixes(words, top)
        left = words[order - 1].astype(np.min_scalar_type(top))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=top))]).astype(np.int64)
        self.levels = []
        for bit in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            ones = (left >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones.astype(np.uint8))))
            left = np.concatenate([left[~ones], left[ones]])
        # Where each word's occurrences start at the matrix's foot.
        place = np.zeros(top, np.int64)
        word = np.arange(top)
        for bit, bits in self.levels:
            ones = bits.rank(place)
            place = np.where(word >> bit & 1, bits.zeros + ones, place - ones)
        self.foot = place

    def extensions(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, word, start, count, smaller): every word that stands before each interval's phrase, by phrase and word.

        ``start`` and ``count`` are the interval of the word with the phrase; ``smaller`` counts the phrase's occurrences
        after a smaller word.
        """
        source, word = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for _, bits in self.levels:
            ones = bits.rank(np.concatenate([lo, hi]))
            a, b = ones[: len(lo)], ones[len(lo) :]
            zero, one = hi - lo > b - a, b > a
            source, word = np.concatenate([source[zero], source[one]]), np.concatenate([word[zero] * 2, word[one] * 2 + 1])
            lo, hi = np.concatenate([(lo - a)[zero], (bits.zeros + a)[one]]), np.concatenate([(hi - b)[zero], (bits.zeros + b)[one]])
        order = np.argsort(source * len(self.foot) + word)
        source, word, lo, count = source[order], word[order], lo[order], (hi - lo)[order]
        before = np.cumsum(count) - count
        head = np.concatenate([[True], np.diff(source) != 0])[: len(source)]
        return source, word, self.first[word] + lo - self.foot[word], count, before - before[head][np.cumsum(head) - 1]


class Index:
    """Both sides of a text; each is built when it is first needed."""

    def __init__(self, words: np.ndarray):
        self.words, self.top = words, int(words.max(initial=0)) + 1

    @cached_property
    def forward(self) -> Side:
        return Side(self.words, self.top)

    @cached_property
    def reverse(self) -> Side:
        return Side(self.words[::-1], self.top)

    def single(self) -> Phrases:
        """All words but 0 as phrases, word k at k - 1."""
        first = np.concatenate([[0], np.cumsum(np.bincount(self.words, minlength=self.top))])
        return Phrases(first[1:-1], first[1:-1], np.diff(first)[1:])

    def right(self, p: Phrases) -> tuple[np.ndarray, np.ndarray, Phrases]:
        """(phrase, word, longer): the phrases with each word that follows them; 0 ends a passage and follows none."""
        source, word, start, count, smaller = self.reverse.extensions(p.reverse, p.reverse + p.count)
        real = word > 0
        source, word = source[real], word[real]
        return source, word, Phrases(p.forward[source] + smaller[real], start[real], count[real])

    def left(self, p: Phrases) -> tuple[np.ndarray, np.ndarray, Phrases]:
        """(phrase, word, longer): the phrases with each word before them."""
        source, word, start, count, smaller = self.forward.extensions(p.forward, p.forward + p.count)
        real = word > 0
        source, word = source[real], word[real]
        return source, word, Phrases(start[real], p.reverse[source] + smaller[real], count[real])


def chosen(p: Phrases, which: np.ndarray) -> Phrases:
    return Phrases(*(x[which] for x in p))
