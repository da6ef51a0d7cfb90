"""What the operators of this subpackage share: shared storage, sized broadcasts, Arrow helpers."""

from __future__ import annotations

import contextlib
import os
import sys
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder, remove

ROOT = str(Path(__file__).resolve().parents[2])

#: A side is broadcast up to this many bytes (rows times the width of a row); beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


#: Bytes of an Arrow batch for Python workers, unless the session says otherwise: very long texts then come few at a time.
BATCH_BYTES = 8 << 20
_SPARKS_OWN = ("67108864b", "64MB", "67108864")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this library, wherever the driver was started from, and keeps their batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64MB") in _SPARKS_OWN:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    if ROOT not in sys.path:
        sys.path.insert(0, ROOT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folders that materialise() wrote inside the innermost scratch().
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialise(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    at = new_folder(spark)
    df.write.mode("overwrite").parquet(at)
    if (written := _WRITTEN.get()) is not None:
        written.append(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._grist_folder = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing to come reads."""
    for df in tables:
        remove(df.sparkSession, df._grist_folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, all that was materialised inside but what the function it gives was called for."""
    token = _WRITTEN.set([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._grist_folder)
        return df

    try:
        yield keep
    finally:
        for at in _WRITTEN.get() or ():
            if at not in kept:
                remove(spark, at)
        _WRITTEN.reset(token)


def small_or_not(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (best materialised) marked for broadcast if its rows fit in the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def _parts(columns: tuple[Column, ...]) -> list[Column]:
    return [x for c in columns for x in (c.isNull(), c)]


def row_key(*columns: Column) -> Column:
    """64 bits of a row, to spread rows by; rows that agree in all these columns share the key, and others may."""
    return F.xxhash64(*_parts(columns))


def row_keys(*columns: Column) -> tuple[Column, Column]:
    """128 bits that stand for a row, as two columns; rows that agree in all these columns share them."""
    return F.xxhash64(*_parts(columns)), F.xxhash64(F.lit(0x51ED2701), *_parts(columns))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits over 64 bits (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n 64-bit constants that depend on nothing but seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    c = batch.column(batch.schema.get_field_index(name))
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins (one more than there are texts); null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(texts: pa.Array, size: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of rows with about size bytes of text each, one row at least; they bound the memory, not the work."""
    _, at = utf8(texts)
    out, a = [], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, side="right")) - 1)
        out.append((a, min(b, len(texts))))
        a = out[-1][1]
    return out
