"""Quality classifier (operator 8): naive Bayes support vectors.

Indicators of n-grams (features.py) are scaled by the log ratio of their smoothed counts in the two
classes, and a linear hinge-loss model is fitted to them by dual coordinate descent; its weights are
interpolated with their mean size (Wang and Manning 2012; Hsieh et al. 2008). A document is kept if
its score isn't below the threshold.

Defined results: a document with null or empty text has a null score and isn't kept. Without labelled
documents of both classes every document with text scores 1 and is kept. Repeated rows and null ids
are scored row by row; labels that disagree are left out; columns beyond those named are passed over,
or passed through by keep_good().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import column
from .features import SIZE, scores
from .training import MAX_ROWS, fit, labelled_sample

COST, SMOOTH, MIX, EPOCHS, THRESHOLD = 0.02, 1.0, 0.75, 25, 0.0


def nbsvm(x: list[np.ndarray], y: np.ndarray) -> dict:
    """x: each document's features; y: 0 or 1. The model: weights of the plain indicators, and bias."""
    if len(x) == 0 or y.min() == y.max():
        return {"weights": np.zeros(SIZE, np.float32), "bias": 1.0}
    counts = [np.full(SIZE, SMOOTH) for _ in range(2)]
    for f, c in zip(x, y):
        counts[c][f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    sign = np.where(y == 1, 1.0, -1.0)
    cost = COST * len(y) / (2.0 * np.bincount(y, minlength=2))  # a class weighs as much as the other
    square = np.array([np.square(ratio[f]).sum() + 1.0 for f in x])
    w, b, alpha = np.zeros(SIZE), 0.0, np.zeros(len(x))
    chance = np.random.default_rng(8)
    for _ in range(EPOCHS):
        most = 0.0
        for i in chance.permutation(len(x)):
            f, s = x[i], sign[i]
            r = ratio[f]
            gradient = s * (w[f] @ r + b) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[y[i]])
            step = (new - alpha[i]) * s
            if step:
                most = max(most, abs(gradient))
                alpha[i] = new
                w[f] += step * r
                b += step
        if most < 1e-3:
            break
    w = (1 - MIX) * np.abs(w).mean() + MIX * w
    return {"weights": (w * ratio).astype(np.float32), "bias": float(b)}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> dict:
    """A model from at most max_rows labelled documents."""
    return fit(labelled_sample(docs, labels, label, max_rows), nbsvm, max_rows)


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, keep) for each row of docs."""
    weights, bias = model["weights"], model["bias"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pa.array(scores(column(batch, "text"), weights, bias, False), from_pandas=True)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), s, pc.fill_null(pc.greater_equal(s, threshold), False)], ["doc_id", "score", "keep"])

    own = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")
    return own.mapInArrow(task, "doc_id bigint, score double, keep boolean")


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that are kept."""
    weights, bias = model["weights"], model["bias"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(column(batch, "text"), weights, bias, False)
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(task, docs.schema)
