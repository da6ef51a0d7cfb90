"""Fits a model to a bounded sample of labelled documents, in one task on an executor."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column
from .features import features

#: No more labelled documents than this are used to fit; they are chosen by a hash of doc_id.
MAX_ROWS = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, y): up to max_rows documents with a label of 0 or 1. Documents whose labels disagree are left out, as are null ids and labels."""
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .filter("_id IS NOT NULL AND _y IN (0, 1)")
        .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter("_y = _z")
        .select("_id", "_y", F.xxhash64("_id").alias("_h")).orderBy("_h", "_id").limit(max_rows)
    )
    own = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t"))
    # max_rows bounds the broadcast side, whatever the size of the tables.
    return own.join(F.broadcast(known), "_id").select("_h", "_id", F.col("_t").alias("text"), F.col("_y").alias("y"))


def fit(sample: DataFrame, fitter: Callable[[list[np.ndarray], np.ndarray], dict], max_rows: int = MAX_ROWS) -> dict:
    """What fitter makes of the sample's features and labels; the texts meet in one task, only the model comes to the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: list[np.ndarray] = []
        y: list[int] = []
        keys: list[int] = []
        for batch in batches:
            x += [np.sort(f).astype(np.int32) for f in features(column(batch, "text"))]
            y += column(batch, "y").to_pylist()
            keys += zip(column(batch, "_h").to_pylist(), column(batch, "_id").to_pylist(), y[len(keys) :], map(len, x[len(keys) :]))
        order = sorted((i for i in range(len(x)) if len(x[i])), key=keys.__getitem__)[:max_rows]  # the order of arrival isn't fixed
        model = fitter([x[i] for i in order], np.array([y[i] for i in order], np.int8))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = sample.repartition(1).mapInArrow(task, "model binary").collect()
    return pickle.loads(rows[0][0]) if rows else fitter([], np.zeros(0, np.int8))
