"""Embedding near-dedup (operator 3): Euclidean p-stable hashing of normalised vectors, then exact cosines.

Each of several tables quantises ROWS Gaussian projections of the unit vector, floor((a.x + b) / WIDTH) (Datar et al. 2004); vectors that
agree in all of a table's numbers meet there. On unit vectors the Euclidean distance is sqrt(2 - 2 cos), so the number of tables
follows from the recall that is wanted at the cosine threshold. All pairs of vectors that meet are verified by exact cosines in double
precision, each vector shipped once to its group (meeting.py).

The result has a row for each vector that has an equal or a similar one: its class, which is all that equal and similar pairs connect, named by its
least vec_id, and the number of links, other different vectors with a cosine at or above the threshold.

Defined results: null, empty and zero vectors, and such with a null, NaN or infinite element, take part in nothing; vectors of different dimension
never meet. Rows of equal vectors are copies of each other, with the same vec_id or not. Rows without vec_id are like others; a class without any
vec_id is named null. An empty table gives none; other columns are passed over, or passed through by drop_near().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, mix, row_keys, seeds
from .meeting import SHIPPED, TASK, class_rows, classes, placed, surplus, tasks, verified, without

THRESHOLD, RECALL, WIDTH, ROWS, SEED = 0.95, 0.95, 2.0, 20, 3


def collision(distance: float, width: float) -> float:
    """The probability that one quantised projection of two points at this distance agrees."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return 1 - 2 * 0.5 * math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def choose_tables(threshold: float, recall: float, width: float = WIDTH, rows: int = ROWS) -> int:
    """How many tables find a pair at the threshold with this probability."""
    p = collision(math.sqrt(max(0.0, 2 - 2 * threshold)), width) ** rows
    return 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))


def bucket_keys(unit: np.ndarray, tables: int, rows: int, width: float, seed: int = SEED) -> np.ndarray:
    """A 64-bit key for each vector and table."""
    n, d = unit.shape
    chance = np.random.default_rng([seed, d])
    a, b = chance.standard_normal((d, tables * rows)), chance.uniform(0, width, tables * rows)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).view(np.uint64).reshape(n, tables, rows)
    salt = seeds(tables + rows, 33 + d)
    return mix((mix(cells + np.uint64(1)) * salt[tables:]).sum(axis=2, dtype=np.uint64) + salt[:tables]).view(np.int64)


def _usable(vectors: DataFrame) -> DataFrame:
    """(id, r1, r2, f1, f2, v): the usable vectors in double precision; f1 and f2 stand for the vector, r1 and r2 for it and its id."""
    own = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter("size(v) > 0")
    own = own.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).filter(F.exists("v", lambda x: x != 0))
    (r1, r2), (f1, f2) = row_keys(F.col("id"), F.size("v"), F.col("v")), row_keys(F.size("v"), F.col("v"))
    return own.select("id", r1.alias("r1"), r2.alias("r2"), f1.alias("f1"), f2.alias("f2"), "v")


def _unit(values: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the vectors of each dimension."""
    flat, lengths = values.flatten().to_numpy(zero_copy_only=False), values.value_lengths().to_numpy()
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = []
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        x = flat[starts[at][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((at, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def alike(loads: list[bytes], parts: np.ndarray, labels: np.ndarray, forest: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The allowed pairs of unit vectors whose cosine is at or above the threshold."""
    a, b = [], []
    size = np.array([len(x) for x in loads])
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = np.frombuffer(b"".join(loads[i] for i in at), np.float64).reshape(len(at), -1)
        for lo in range(0, len(at), 512):
            i, j = np.nonzero(x[lo : lo + 512] @ x[lo:].T >= threshold)
            i, j = at[i + lo], at[j + lo]
            ok = (i < j) & (labels[i] != labels[j]) & ((parts[i] < 0) | (parts[i] != parts[j]))
            a.append(i[ok])
            b.append(j[ok])
    return np.concatenate(a), np.concatenate(b)


def _classes(vectors: DataFrame, threshold: float, recall: float, width: float, rows: int, forest: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    tables = choose_tables(threshold, recall, width, rows)
    own = _usable(vectors)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _unit(column(batch, "v")):
                keys = bucket_keys(unit, tables, rows, width)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                part = batch.take(pa.array(at))
                names = ["id", "r1", "r2", "f1", "f2"]
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in names), pa.array(np.full(len(at), 8 * unit.shape[1])), lists], [*names, "size", "bands"])

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _unit(column(batch, "v")):
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in SHIPPED), pa.array([x.tobytes() for x in unit], pa.binary())], [*SHIPPED, "load"])

    def matches(items: DataFrame) -> DataFrame:
        needed = placed(tasks(items.select("rep", "size", "bands")), items)
        shipped = own.join(needed, ["r1", "r2"]).select(*SHIPPED, "v").mapInArrow(ship, f"{TASK}, load binary")
        return verified(shipped, lambda loads, parts, labels, forest: alike(loads, parts, labels, forest, threshold), forest)

    return classes(own.mapInArrow(hashed, "id bigint, r1 bigint, r2 bigint, f1 bigint, f2 bigint, size bigint, bands array<bigint>"), matches)


def similar_classes(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH, rows: int = ROWS) -> DataFrame:
    """(vec_id, class_id, links) of each vector that has an equal or a similar one; every pair at or above the threshold is found with at least this recall."""
    return class_rows(*_classes(vectors, threshold, recall, width, rows, False)).withColumnRenamed("id", "vec_id")


def drop_near(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH, rows: int = ROWS) -> DataFrame:
    """vectors without all but one of each class: the least vec_id stays, one of none only if there is no other. Rows that aren't usable stay."""
    keys = row_keys(vectors["vec_id"].cast("bigint"), F.size(vectors["embedding"].cast("array<double>")), vectors["embedding"].cast("array<double>"))
    return without(vectors, keys, *surplus(*_classes(vectors, threshold, recall, width, rows, True)))
