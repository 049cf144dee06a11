"""Tokenizing texts on executors with a vocabulary file of the tokenizers library.

A text is cut where the vocabulary's own splitting rule must cut as well, and the ids of
each such part are kept for the parts to come, so a part that recurs is encoded once per
worker. Plain words go to the library's model directly, every other part through its whole
encoder, and a text with unusual white space goes through the encoder in one piece.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Parts of a generation that a worker keeps; it keeps two, of parts and of plain runs each: about 200 MB in all.
KEPT_PARTS = 450_000
#: Letters whose NFC form is themselves and whose lower case is one letter of the same range.
LETTERS = "A-Za-zÀ-ÖØ-Þà-öø-þ"
PLAIN = re.compile(f"([{LETTERS}]+)([.,;:!?#$%&*|<>]*)")


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as they are, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Odd(Exception):
    """A part that the splitting rule may join with its neighbours."""


class Kept(dict):
    """Made values by key, in two generations: of the older one, what is asked for again stays."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """Encodes texts as the library's ``encode(text, add_special_tokens=False).ids`` does."""

    def __init__(self, path: str, most: int = KEPT_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.lower = self.whole.normalizer is not None
        self.letters = byte_letters()
        # White space vanishes in a lower-casing vocabulary and joins the next word in a byte-level one.
        self.newline = b"" if self.lower else self._bytes(self.whole.encode("\n", add_special_tokens=False).ids)
        self.after, self.runs = Kept(self._after, most), Kept(self._run, most)

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of a run that is one unit of the splitting rule."""
        return self._bytes([u.id for u in self.model.tokenize(run.encode().decode("latin-1").translate(self.letters))])

    def _after(self, part: str) -> bytes:
        """Ids of a part with one blank before it."""
        if not part or part[0].isspace() or part[-1].isspace():
            raise Odd
        return self._part(part, True)

    def _part(self, part: str, space: bool) -> bytes:
        """Ids of a part without white space at its ends; ``space``: one blank stands before it."""
        if m := PLAIN.fullmatch(part):
            word, marks = m.groups()
            word = word.lower() if self.lower else " " + word if space else word
            return self.runs[word] + self.runs[marks] if marks else self.runs[word]
        if "\n" in part:
            lines = part.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                return self.newline.join([self._part(lines[0], space), *(self._part(x, False) for x in lines[1:])])
        return self._bytes(self.whole.encode(" " + part if space else part, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, each in ``dtype``."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            ids = b"".join(map(self.after.__getitem__, rest))
        except Odd:
            return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)
        if not first or first[0].isspace() or first[-1].isspace():
            return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)
        return self._part(first, False) + ids


_loaded: dict[tuple, Vocabulary] = {}


def forget() -> None:
    """Let go of this worker's vocabulary, when other work begins."""
    _loaded.clear()


def vocabulary(path: str, most: int = KEPT_PARTS) -> Vocabulary:
    """This worker's vocabulary for a file, kept with what it has learned between tasks."""
    if (path, most) not in _loaded:
        _loaded.clear()
        _loaded[path, most] = Vocabulary(path, most)
    return _loaded[path, most]
