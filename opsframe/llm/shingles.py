"""Words and word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = 5
_WORD = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class HashOf(dict):
    """Hash of a string, remembered; forgotten as a whole when too many are held."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASH = HashOf()


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multiplier(place: int) -> np.uint64:
    """An odd multiplier for the word at ``place`` of a shingle."""
    return _ODD[place % len(_ODD)] + np.uint64(2 * (place // len(_ODD)))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of all runs of ``n`` words, repeats included; a shorter text is one run."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for place in range(n):
        out += h[place : place + len(out)] * multiplier(place)
    out = mix(out + np.uint64(n))
    out.sort()
    return out


def repeats(sorted_hashes: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    n = len(sorted_hashes)
    if not n:
        return np.empty(0, np.int64)
    place = np.arange(n)
    first = np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1]))
    return place - np.maximum.accumulate(np.where(first, place, 0))


def numbered(sorted_hashes: np.ndarray) -> np.ndarray:
    """The values of a sorted multiset as distinct ones: the repeats of a value each stand for themselves."""
    return mix(sorted_hashes + repeats(sorted_hashes).astype(np.uint64) * _ODD[0])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller counts over the sum of the larger ones, of two sorted multisets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = numbered(a), numbered(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
