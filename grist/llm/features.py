"""Hashed indicator features of a text: word 1- and 2-grams, and character 2- and 3-grams that keep case and punctuation.

A word that equals the word before it counts as the one marker "repeated", so that runs of any
word share features. The first HALF features are of words, the rest of characters (Unicode code points).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix, pieces, seeds, utf8
from .text import Words

BITS = 18
SIZE = 1 << BITS
HALF = SIZE >> 1
_REPEATED = np.uint64(0x5EED0FE1)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS + 1)).astype(np.int32)


def _spread(h: np.ndarray, factor: np.uint32) -> np.ndarray:
    """Features of character n-grams from their polynomial hashes; the upper bits decide, after the lower ones were folded into them."""
    h = (h ^ (h >> np.uint32(15))) * factor
    h ^= h >> np.uint32(13)
    return (h * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS + 1)).astype(np.int32) + HALF


def _of_piece(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the features it has, with repeats."""
    words, (raw, at) = Words(texts), utf8(texts)
    h, s = words.hash.copy(), seeds(3, 5)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    firsts = words.bounds[:-1]
    same[firsts[firsts < len(h)]] = False
    h[same] = _REPEATED
    one = _buckets(mix(h + s[0]))
    two = _buckets(mix(h[:-1] * s[1] + h[1:] + s[2])) if len(h) > 1 else np.zeros(0, np.int32)
    whole = raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
    wide = np.frombuffer(whole, np.uint32)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]  # characters before each text
    pair = wide[:-1] * np.uint32(0x01000193) + wide[1:] if len(wide) > 1 else np.zeros(0, np.uint32)
    triple = pair[:-1] * np.uint32(0x01000193) + wide[2:] if len(wide) > 2 else np.zeros(0, np.uint32)
    pair, triple = _spread(pair, np.uint32(0x9E3779B1)), _spread(triple, np.uint32(0x85EBCA6B))
    for i in range(len(texts)):
        a, b, c, d = before[i], before[i + 1], words.bounds[i], words.bounds[i + 1]
        yield np.concatenate([one[c:d], two[c : max(c, d - 1)], pair[a : max(a, b - 1)], triple[a : max(a, b - 2)]])


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the distinct features it has (in no order); none for null or empty text."""
    stamp = np.zeros(SIZE, np.int32)
    for a, b in pieces(texts):
        for found in _of_piece(texts.slice(a, b - a)):
            order = np.arange(len(found), dtype=np.int32)
            stamp[found] = order
            yield found[stamp[found] == order]


def scores(texts: pa.Array, weights: np.ndarray, bias: float, root: bool) -> np.ndarray:
    """bias plus the weights of each text's features, divided by the root of their number if root; NaN for texts without any."""
    out = np.full(len(texts), np.nan)
    for i, x in enumerate(features(texts)):
        if len(x):
            out[i] = bias + float(weights[x].sum(dtype=np.float64)) / (np.sqrt(len(x)) if root else 1.0)
    return out
