"""Small linear models fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None, steps: int = 12) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        gain = x.T @ (weight * (y - p)) - penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gain)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def linear(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` distinct rows of docs with a known label: `_id`, `_label` and docs' columns; those whose doc_id hashes lowest.

    Labels that are null or contradict each other for a doc_id don't count.  Rows that repeat
    count once, so one id that is there very often can't fill the sample with copies.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).alias("_label"), F.max(label).alias("_other"))
    known = known.where("_label = _other").orderBy(F.xxhash64("_id"), "_id").limit(rows).select("_id", F.col("_label").cast("int").alias("_label"))
    found = docs.join(F.broadcast(known), docs["doc_id"] == F.col("_id")).distinct()
    return found.orderBy(F.xxhash64("_id"), "_id", F.xxhash64(*docs.columns)).limit(rows)
