"""Quality rules (operator 5): hashed word and character n-gram logistic regression, calibrated, against fixed thresholds.

The indicators of features.py, divided by the root of their number, go into an L2-regularised logistic
regression fitted by L-BFGS to labelled quality rows; Platt's sigmoid is fitted to the held-out fifth.
Rules: probability >= KEEP is "keep", >= REVIEW "review", below "reject".

Defined results: null or empty text has a null probability and the rule "reject"; without labelled rows of
both classes each text has probability 1 ("keep"). Rows are scored one by one, repeated or not; null ids
stay null; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column
from .features import SIZE, scores
from .training import MAX_ROWS, fit, labelled_sample

L2, ITERATIONS, MEMORY = 1e-4, 60, 8
KEEP, REVIEW = 0.5, 0.2


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _lbfgs(value, w: np.ndarray) -> np.ndarray:
    """A minimum of value(w) -> (loss, gradient), by limited-memory BFGS with backtracking."""
    loss, g = value(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ITERATIONS):
        q, used = g.copy(), []
        for s, d, rho in reversed(past):
            a = rho * (s @ q)
            used.append(a)
            q -= a * d
        if past:
            s, d, _ = past[-1]
            q *= (s @ d) / (d @ d)
        for (s, d, rho), a in zip(past, reversed(used)):
            q += s * (a - rho * (d @ q))
        step, slope = 1.0 if past else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12)) * 10, g @ q
        while True:
            new = w - step * q
            loss2, g2 = value(new)
            if loss2 <= loss - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, d = new - w, g2 - g
        done = abs(loss - loss2) < 1e-7 * max(1.0, abs(loss))
        w, g, loss = new, g2, loss2
        if (curve := s @ d) > 1e-12:
            past = [*past, (s, d, 1.0 / curve)][-MEMORY:]
        if done:
            break
    return w


def logistic(x: list[np.ndarray], y: np.ndarray) -> dict:
    """weights and bias of the calibrated model: the score is the logit of the probability."""
    if len(x) == 0 or y.min() == y.max():
        return {"weights": np.zeros(SIZE, np.float32), "bias": 500.0}
    held = np.arange(len(x)) % 5 == 4
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False
    own = [x[i] for i in np.flatnonzero(~held)]
    t = y[~held].astype(float)
    flat, lengths = np.concatenate(own), np.array([len(f) for f in own])
    starts, scale = np.concatenate([[0], np.cumsum(lengths)[:-1]]), 1.0 / np.sqrt(lengths)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.add.reduceat(w[flat], starts) * scale + w[SIZE]
        miss = _sigmoid(z) - t
        g = np.zeros(SIZE + 1)
        for a in range(0, len(own), 512):  # in parts, to need little memory
            b = min(a + 512, len(own))
            lo, hi = starts[a], starts[b - 1] + lengths[b - 1]
            g[:SIZE] += np.bincount(flat[lo:hi], np.repeat(miss[a:b] * scale[a:b], lengths[a:b]), SIZE)
        g[SIZE] = miss.sum()
        g = g / len(t) + L2 * np.append(w[:SIZE], 0)
        return float(np.logaddexp(0, np.where(t == 1, -z, z)).mean() + L2 / 2 * (w[:SIZE] @ w[:SIZE])), g

    w = _lbfgs(value, np.zeros(SIZE + 1))
    a, b = 1.0, 0.0
    if held.any():
        z = np.array([w[x[i]].sum() / np.sqrt(len(x[i])) + w[SIZE] for i in np.flatnonzero(held)])
        pos, neg = (y[held] == 1).sum(), (y[held] == 0).sum()
        goal = np.where(y[held] == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))  # Platt's targets

        def platt(v: np.ndarray) -> tuple[float, np.ndarray]:
            u = v[0] * z + v[1]
            miss = _sigmoid(u) - goal
            return float((np.logaddexp(0, u) - goal * u).mean()), np.array([(miss * z).mean(), miss.mean()])

        a, b = _lbfgs(platt, np.array([1.0, 0.0]))
    return {"weights": (a * w[:SIZE]).astype(np.float32), "bias": float(a * w[SIZE] + b)}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> dict:
    """A model from at most max_rows labelled documents."""
    return fit(labelled_sample(docs, labels, label, max_rows), logistic, max_rows)


def apply_rules(docs: DataFrame, model: dict, keep: float = KEEP, review: float = REVIEW) -> DataFrame:
    """(doc_id, probability, rule) for each row of docs."""
    weights, bias = model["weights"], model["bias"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _sigmoid(scores(column(batch, "text"), weights, bias, True))
            rule = np.where(p >= keep, "keep", np.where(p >= review, "review", "reject"))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(p, from_pandas=True), pa.array(rule, pa.string())], ["doc_id", "probability", "rule"])

    own = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")
    return own.mapInArrow(task, "doc_id bigint, probability double, rule string")
