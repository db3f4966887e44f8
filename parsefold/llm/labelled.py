"""Labelled training rows of bounded number, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsefold.llm.common import crc_fold, table

#: crc32(doc_id) mod FOLDS of 0 is held out and never learned from.
FOLDS = 5


def training_labels(labels: DataFrame, column: str, per_class: int, doc_id: str = "doc_id") -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, label) of at most `per_class` rows of each label outside the held-out
    fold, in hash order of the id, and the share of all such rows that each label has.
    Rows without id or with a label other than 0 or 1 are left out; an id with several
    labels counts with its smallest."""
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_fold(F.col("doc_id"), FOLDS) != 0))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = max(1, sum(counts.values()))
    pick = lambda c: rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return table(pick(0).unionByName(pick(1)), "sampled-labels"), {c: counts.get(c, 0) / total for c in (0, 1)}


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(axis=0), x.std(axis=0) + 1e-6


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last entry is the intercept."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    weight = weight / weight.sum()
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty @ w
        curvature = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + penalty
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
