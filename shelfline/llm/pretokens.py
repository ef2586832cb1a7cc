"""Exact byte-level BPE of whole texts through a cache of pre-tokens.

The tokenizer splits a text into pre-tokens by a pattern and encodes each on its own, so the encoding of a text is
the encodings of its pre-tokens in order.  Texts of characters for which Python's classes are the pattern's classes
take that way; a text with any other character, or with a special token's string, goes whole to the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import compress, repeat
from operator import is_

import numpy as np

SLICE = 1 << 20
CACHE = 750_000
LINES = 1_000  # pre-tokens that go to the library as the lines of one text
# the pre-token pattern of the vocabulary file, written with the classes of Python's re
PATTERN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Basic Latin without the separators 1C-1F, Latin-1 letters and signs without superscripts and fractions, Latin
# Extended-A and -B, and general punctuation: here letters, digits and white space mean the same to both
OTHER = re.compile("[^\\x00-\\x1b\\x20-\\x7f\\xa0-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]")
SPECIAL = "<|endoftext|>"
CUT = re.compile(r"(?<=\S) (?=\S)")


def vocabulary(path: str | None = None) -> str:
    """The vocabulary file: a parameter, by default the installed public one."""
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Values of pre-tokens, cached in the worker: ``value`` makes one from a sequence of ids."""

    def __init__(self, path: str, value: Callable[[Sequence[int]], object], known: dict[str, object] | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores
        from tokenizers import Tokenizer
        self.tokenizer, self.value = Tokenizer.from_file(path), value
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        line = self.ids(["\n"])[0]
        self.line = line[0] if len(line) == 1 else -1
        self.known = known or {}
        self.cache = dict(self.known)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, parts: list[str]) -> list[object]:
        """Values of pre-tokens.  Those with a character other than white space go to the library many at once, one a line:
        a line end is a pre-token of its own there, so its id cuts the ids into lines again."""
        words = [x for x in parts if not x.isspace()]
        found = {}
        for at in range(0, len(words), LINES):
            some = words[at:at + LINES]
            ids = np.asarray(self.ids(["\n".join(some)])[0], "<u4")
            ends = np.flatnonzero(ids == self.line).tolist()
            if len(ends) == len(some) - 1:
                found.update(zip(some, (self.value(ids[a:b]) for a, b in zip([0, *(x + 1 for x in ends)], [*ends, len(ids)], strict=True)), strict=True))
        left = [x for x in parts if x not in found]
        found.update(zip(left, map(self.value, self.ids(left)), strict=True))
        return [found[x] for x in parts]

    def _values(self, parts: list[list[str]]) -> list[list[object]]:
        values = [list(map(self.cache.get, x)) for x in parts]
        gaps = [list(compress(range(len(y)), map(is_, y, repeat(None)))) for y in values]
        missing = list({x[i] for x, at in zip(parts, gaps, strict=True) for i in at})
        if missing:
            new = dict(zip(missing, self._encoded(missing), strict=True))
            for x, y, at in zip(parts, values, gaps, strict=True):
                for i in at:
                    y[i] = new[x[i]]
            if len(self.cache) + len(new) > CACHE + len(self.known):  # begin anew with what these texts hold
                self.cache = dict(self.known)
                for x, y in zip(parts, values, strict=True):
                    self.cache.update(zip(x, y, strict=True))
            else:
                self.cache.update(new)
        return values

    def encode(self, texts: list[str | None]) -> Iterator[list[object]]:
        """For each text the values whose concatenation or sum is the text's."""
        held: list[list[str]] = []
        for text in texts:
            text = text or ""
            if OTHER.search(text) or SPECIAL in text:
                yield from self._values(held)
                held = []
                yield [self.value(self.ids([text])[0])]
            elif len(text) > SLICE:
                yield from self._values(held)
                held = []
                out, at = [], 0
                while at < len(text):
                    cut = CUT.search(text, at + SLICE) if at + SLICE < len(text) else None
                    end = cut.start() if cut else len(text)
                    out += self._values([PATTERN.findall(text, at, end)])[0]
                    at = end
                yield out
            else:
                held.append(PATTERN.findall(text))
        yield from self._values(held)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str, value: Callable[[Sequence[int]], object], known: Callable[[], dict[str, object]] | None = None) -> Encoder:
    """The worker's encoder for this vocabulary and kind of value; it outlives the task."""
    key = (path, kind)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, value, known() if known else None)
    return _encoders[key]


def forget() -> None:
    """Frees the worker's encoder and its cache: for a step that tokenizes nothing, in a worker that may have served one that did."""
    _encoders.clear()
