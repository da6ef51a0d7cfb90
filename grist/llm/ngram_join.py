"""N-gram Jaccard join (operator 6): MinHash banding, then full n-gram sets.

1. Documents with the same words in the same order form one *text*; its MinHash signature is cut into bands; how many bands
   of how many rows follows from the recall that is wanted at the threshold. A shuffle on the bands' hashes brings texts together.
2. Every pair of texts that shares a band is verified, in groups (meeting.py): each ships its full n-gram set there, so that groups of
   thousands of near copies move in proportion to their size, not to their pairs.

Verification compares full sets of 64-bit n-gram hashes, so precision is exact; recall at the threshold is at
least RECALL, and higher above it.

The join's result has a row for each document that has a copy or a similar text: its class, which is all that copies and similar pairs connect, named
by its least doc_id, and the number of links, other texts that are similar to its own. Groups of near copies have pairs in
proportion to the square of their size; their classes and numbers of links don't.

Defined results: text that is null, empty or without words takes part in nothing. A text of fewer than n words has one
gram. Rows that agree in doc_id and text are copies of each other, rows with one doc_id and other texts are compared as they
are. Rows without doc_id are like others; a class without any doc_id is named null. An empty table gives none. Other columns are
passed over, or passed through by drop_copies().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import column, mix, pieces, row_keys, seeds
from .meeting import SHIPPED, TASK, allowed, class_rows, classes, placed, surplus, tasks, verified, without
from .text import Words

N, THRESHOLD, RECALL, MAX_HASHES = 3, 0.5, 0.95, 192


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows as the recall at the threshold and the number of hashes allow."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p)) if p > 1e-12 else max_hashes + 1
        if bands * rows <= max_hashes:
            best = (max(1, bands), rows)
    if best is None:
        raise ValueError(f"no bands of at most {max_hashes} hashes reach recall {recall} at {threshold}")
    return best


def minhash(grams: np.ndarray, bounds: np.ndarray, hashes: int) -> np.ndarray:
    """A signature of 32-bit minima for each text that has grams."""
    s = seeds(2 * hashes, 66)
    factor, shift = (s[:hashes] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (s[hashes:] >> np.uint64(32)).astype(np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out, work = np.empty((len(starts), hashes), np.uint32), np.empty_like(short)
    if len(starts):
        for k in range(hashes):
            np.multiply(short, factor[k], out=work)
            work += shift[k]
            out[:, k] = np.minimum.reduceat(work, starts)
    return out


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    return row_keys(docs["doc_id"].cast("bigint"), docs["text"].cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    r1, r2 = _keys(docs)
    own = docs.select(docs["doc_id"].cast("bigint").alias("id"), docs["text"].cast("string").alias("text"), r1.alias("r1"), r2.alias("r2"))
    return own.filter("text IS NOT NULL AND text <> ''")


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, r1, r2, f1, f2, size, bands) of each document that has words; f1 and f2 stand for its words in their order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = seeds(bands + rows, 606)
        for batch in batches:
            texts = column(batch, "text")
            for a, b in pieces(texts):
                words = Words(texts.slice(a, b - a))
                grams, bounds = words.ngrams(n)
                sig, there = minhash(grams, bounds, bands * rows), np.flatnonzero(np.diff(bounds) > 0)
                parts = (sig.reshape(len(sig), bands, rows).astype(np.uint64) * salt[bands:]).sum(axis=2, dtype=np.uint64)
                keys = mix(parts + salt[:bands]).view(np.int64)
                seq = words.sequence()[there].view(np.int64)
                out = batch.slice(a, b - a).take(pa.array(there))
                yield pa.RecordBatch.from_arrays(
                    [*(column(out, c) for c in ("id", "r1", "r2")), pa.array(seq[:, 0]), pa.array(seq[:, 1]), pa.array(np.diff(bounds)[there].astype(np.int64) * 8),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))],
                    ["id", "r1", "r2", "f1", "f2", "size", "bands"],
                )

    return _keyed(docs).select("id", "r1", "r2", "text").mapInArrow(task, "id bigint, r1 bigint, r2 bigint, f1 bigint, f2 bigint, size bigint, bands array<bigint>")


def alike(loads: list[bytes], parts: np.ndarray, labels: np.ndarray, forest: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The allowed pairs of n-gram sets at or above the threshold; with forest, what two others connect already isn't compared."""
    sets = [np.frombuffer(x, np.uint64) for x in loads]
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        hit = int(allowed(0, parts, labels)[0] and common >= threshold * (len(sets[0]) + len(sets[1]) - common))
        return np.zeros(hit, np.int64), np.ones(hit, np.int64)
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(flat.max() + 1, bool)
    root = np.arange(len(sets))
    a, b = [], []
    for i in range(len(sets) - 1):
        want = allowed(i, parts, labels)
        if forest:
            want &= root[i + 1 :] != root[i]
        if not want.any():
            continue
        mark[flat[at[i] : at[i + 1]]] = True
        common = np.add.reduceat(mark[flat[at[i + 1] :]], at[i + 1 : -1] - at[i + 1], dtype=np.int64)
        mark[flat[at[i] : at[i + 1]]] = False
        hit = np.flatnonzero(want & (common >= threshold * (size[i] + size[i + 1 :] - common))) + i + 1
        a.append(np.full(len(hit), i))
        b.append(hit)
        if forest and len(hit):
            joined = np.unique(np.append(root[hit], root[i]))
            root[np.isin(root, joined)] = joined[0]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _classes(docs: DataFrame, threshold: float, n: int, recall: float, forest: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    bands, rows = choose_bands(threshold, recall)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_of = column(batch, "text")
            for a, b in pieces(words_of):
                grams, bounds = Words(words_of.slice(a, b - a)).ngrams(n)
                loads = [np.unique(grams[bounds[i] : bounds[i + 1]]).tobytes() for i in range(b - a)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in SHIPPED), pa.array(loads, pa.binary())], [*SHIPPED, "load"])

    def matches(items: DataFrame) -> DataFrame:
        needed = placed(tasks(items.select("rep", "size", "bands")), items)
        wanted = _keyed(docs).select("r1", "r2", "text").join(needed, ["r1", "r2"]).select(*SHIPPED, "text")
        shipped = wanted.mapInArrow(sets, f"{TASK}, load binary")
        return verified(shipped, lambda loads, parts, labels, forest: alike(loads, parts, labels, forest, threshold), forest)

    return classes(_signed(docs, n, bands, rows), matches)


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, links) of each document that has a copy or a similar text."""
    return class_rows(*_classes(docs, threshold, n, recall, False)).withColumnRenamed("id", "doc_id")


def drop_copies(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """docs without all but one of each class: the least doc_id stays, one of none only if there is no other. Texts without words stay."""
    return without(docs, _keys(docs), *surplus(*_classes(docs, threshold, n, recall, True)))
