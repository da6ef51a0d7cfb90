"""Words and n-grams of whole batches of texts as NumPy arrays, straight from Arrow's buffers.

A word is a maximal run of characters other than ASCII white space, control characters and
punctuation, in lower case. No Python object is made per word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix, seeds, utf8

#: The same words as words() takes, for small things and for tests.
WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

_IS_WORD = np.ones(256, bool)
_IS_WORD[:128] = [chr(i).isalnum() for i in range(128)]
_BASE = 0x100000001B3 * 8 + 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """_BASE and its inverse to the powers 0 to n - 1, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        kept = [np.empty(size, np.uint64) for _ in range(2)]
        for out, x in zip(kept, (_BASE, _INVERSE)):
            out[0] = 1
            out[1:] = np.uint64(x)
            np.multiply.accumulate(out, out=out)
        if n > 1 << 22:
            return kept
        _POWERS[:] = kept
    return _POWERS


class Words:
    """words of a batch: start and end (bytes), hash, and doc's bounds in words (one more than docs)."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.data, self.at = utf8(pc.utf8_lower(texts.cast(pa.large_string())) if lower else texts)
        data, at, n = self.data, self.at, len(self.data)
        inside = _IS_WORD[data]
        begins, ends = inside.copy(), inside.copy()
        if n:
            cut = at[:-1][(at[:-1] < n) & (np.diff(at) > 0)]  # a word never reaches over two texts
            begins[1:] &= ~inside[:-1]
            begins[cut] = inside[cut]
            ends[:-1] &= ~inside[1:]
            last = cut[cut > 0] - 1
            ends[last] = inside[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        self.bounds = np.searchsorted(self.start, at)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of words of each text, with repeats, and each text's bounds in them. A text of fewer than n words, but one at least, has one gram: all its words."""
        h, count = self.hash, np.diff(self.bounds)
        factor = seeds(n, 77)
        sizes = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        first = np.repeat(self.bounds[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
        grams = np.zeros(len(first), np.uint64)
        left = np.repeat(np.minimum(count, n), sizes)  # words that this gram has
        for k in range(n):
            use = left > k
            grams += np.where(use, h[np.minimum(first + k, max(len(h) - 1, 0))] * factor[k], np.uint64(0)) if len(h) else np.uint64(0)
        return mix(grams + left.astype(np.uint64)), bounds

    def sequence(self) -> np.ndarray:
        """Two 64-bit hashes of each text's words in their order; of a text without words, of nothing."""
        out = np.zeros((len(self.at) - 1, 2), np.uint64)
        count = np.diff(self.bounds)
        place = np.arange(len(self.hash)) - np.repeat(self.bounds[:-1], count)
        full = np.flatnonzero(count > 0)
        for k in range(2):
            part = mix(self.hash + mix(place.astype(np.uint64) * np.uint64(2 * k + 1) + np.uint64(0x51ED2701 * (k + 1))))
            if len(full):
                out[full, k] = np.add.reduceat(part, self.bounds[:-1][full])
        return mix(out + count.astype(np.uint64)[:, None])


def gram_set(text: str | None, n: int) -> frozenset:
    """The n-grams of one text as tuples, the plain way; for tests."""
    words = WORD.findall((text or "").lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))
