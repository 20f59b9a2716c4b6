"""A bounded sample of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label): the documents of at most `rows` label rows outside the held-out fold, the first by a hash of their id; label rows without an id or a label don't count."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(F.col(id_col), folds) != held_out))
    picked = usable.orderBy(F.xxhash64(id_col), id_col).limit(rows).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("label"))
    text = docs.select(F.col(id_col).alias("__doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    return text.join(F.broadcast(picked), F.col("__doc") == F.col("__id")).select("text", "label")


def logistic(x, y, ridge: float = 1e-2, steps: int = 60):
    """Weights (bias last) of a ridge logistic regression by damped Newton steps."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return w
