"""Hashes of the words and word shingles of whole texts, in NumPy over the bytes of a batch.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.  UTF-8 never uses those bytes
inside a longer character, so bytes and characters split alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

SPACE = re.compile(rb"[\x20\x09-\x0D]")
CHUNK = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=_U) | _U(1)
_TABLE[65:91] = _TABLE[97:123]
# classes of bytes: 0 white space, otherwise part of a run of one class
PLAIN = np.ones(256, np.int8)
PLAIN[[9, 10, 11, 12, 13, 32]] = 0
WORD_PUNCT = PLAIN * 2  # 1: letters, digits and all beyond ASCII; 2: ASCII punctuation
WORD_PUNCT[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
_BASE = 0x9E3779B97F4A7C15
_STEP = _rng.integers(1, 2**63, 5, dtype=_U) | _U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, CHUNK + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(m, base, _U)
            p[0] = 1
            _powers[k:k + 1] = [np.cumprod(p, dtype=_U)]
    return _powers[0], _powers[1]


def _hashed(buffer: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of one class: a polynomial in the bytes, from prefix sums modulo 2**64."""
    a = np.frombuffer(buffer, np.uint8)
    kind = np.zeros(len(a) + 2, np.int8)
    kind[1:-1] = classes[a]
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    inside = kind[edge + 1] > 0
    start, end = edge[inside], np.append(edge[1:], len(a))[inside]
    up, down = _power(len(a) + 1)
    sums = np.empty(len(a) + 1, _U)
    sums[0] = 0
    np.cumsum(_TABLE[a] * up[:len(a)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def word_hashes(texts: Iterable[bytes | None], classes: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and the number of words of each text.

    Works on about CHUNK bytes at a time, cut at white space, so memory does not follow a text's length
    beyond its own words.
    """
    out: list[np.ndarray] = []
    counts: list[int] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            start, h = _hashed(b" ".join(held), classes)
            at = np.cumsum([0, *(len(x) + 1 for x in held)])
            counts.extend(np.diff(np.searchsorted(start, at)).tolist())
            out.append(h)
        held, size = [], 0

    for text in texts:
        text = text or b""
        if len(text) <= CHUNK // 2:
            held.append(text)
            size += len(text) + 1
            if size > CHUNK // 2:
                flush()
            continue
        flush()
        n = at = 0
        while at < len(text):
            cut = SPACE.search(text, min(len(text), at + CHUNK))
            end = cut.start() if cut else len(text)
            h = _hashed(text[at:end], classes)[1]
            n += len(h)
            out.append(h)
            at = end + 1
        counts.append(n)
    flush()
    return (np.concatenate(out) if out else np.empty(0, _U)), np.asarray(counts, np.int64)


def shingle_sets(texts: Iterable[bytes | None], k: int = 5) -> Iterable[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, its whole sequence."""
    words, counts = word_hashes(texts)
    total = np.zeros(max(0, len(words) - k + 1), _U)
    for j in range(k):
        total += words[j:len(words) - k + 1 + j] * _STEP[j]
    total = mix(total + _U(k))
    at = 0
    for n in counts.tolist():
        if n >= k:
            yield np.unique(total[at:at + n - k + 1])
        elif n:
            yield mix(np.sum(words[at:at + n] * _STEP[:n], dtype=_U, keepdims=True) + _U(n))
        else:
            yield np.empty(0, _U)
        at += n
