"""Hashes of words, shingles and byte windows in numpy; the same in every process."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Words kept with their hashes, and the bytes of a word up to which it is kept.
KEPT_WORDS, KEPT_BYTES = 1 << 20, 64
#: Bytes hashed at once; texts are cut between words.
AT_ONCE = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), b)]))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def prefixes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i], times the inverse's power i, the polynomial of bytes i to j."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


class _Known(dict):
    """Hashes of words by blake2b, which cannot be made to collide as polynomials can; short words are kept, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = h
        return h


_known = _Known()


def word_hashes(data: bytes) -> np.ndarray:
    """Of the words between ASCII white space, in order; data has A-Z lowered already if that is wanted."""
    out, low = [], 0
    while low < len(data):
        high = low + AT_ONCE
        if high < len(data):
            blank = BLANK.search(data, high)
            high = blank.start() if blank else len(data)
        words = data[low:high].split()
        out.append(np.fromiter(map(_known.__getitem__, words), np.uint64, len(words)))
        low = high
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The different shingles of k words, sorted; fewer words make one shingle of them all; no words, none."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.full(len(words) - k + 1, np.uint64(k))
    for j in range(k):
        h = mix(h * M1 + words[j : len(words) - k + 1 + j])
    return np.unique(h)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
