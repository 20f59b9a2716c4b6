"""Quality scores from a regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics. A bounded sample of
labelled rows gives each class a mean and a covariance, shrunk towards the
pooled one and its diagonal; the Cholesky factors are computed once. The
difference of the two Mahalanobis log-densities is mapped to a probability by a
one-dimensional logistic fit on the same sample.

Rows: null texts count as empty. Every row gets a row, repeated ones too, with a
score between 0 and 1 whatever its length. Without labelled rows of both
classes every score is the share of label 1 (0.5 without any). An empty table
gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.labelled import fold, logistic, sample

#: Bound of the labelled sample.
ROWS = 6000

KINDS = np.zeros((5, 256), np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~")):
    KINDS[_k, list(_chars)] = 1
NAMES = ("length", "upper", "digits", "punctuation", "symbols", "symbol words", "distinct words", "commonest word", "doubled words", "word length", "line length", "repeated lines", "squeezed")


def statistics(text: str | None) -> list[float]:
    """The document's vector. Shares are smoothed towards usual values, so very short texts are not extreme."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    upper, lower, digit, punct, symbol = (KINDS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)).tolist()
    words = raw.split()
    counts = Counter(words)
    m = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    most = counts.most_common(1)[0][1] if m else 0
    odd = sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum() or w[-1] in b"!#$%&*+/<=>@\\^_`|~")
    share = lambda part, whole, usual, weight=20: (part + usual * weight) / (whole + weight)
    logit = lambda p: float(np.log(p / (1 - p)))
    return [
        float(np.log1p(n)),
        logit(share(upper, upper + lower, 0.04)),
        logit(share(digit, n, 0.005)),
        logit(share(punct, n, 0.02)),
        logit(share(symbol, n, 0.005, 100)),
        logit(share(odd, m, 0.02)),
        float(np.log((len(counts) + 10) / (m + 10)) + 0.12 * np.log(m + 10)),
        logit(share(most, m, 0.06)),
        logit(share(sum(map(bytes.__eq__, words, words[1:])), m, 0.01)),
        float(np.log((n + 60) / (m + 10))),
        float(np.log((n + 200) / (len(lines) + 2))),
        logit(share(len(lines) - len(set(lines)), len(lines), 0.02)),
        float(np.log((len(zlib.compress(raw, 1)) + 40) / (n + 80)) + 0.05 * np.log(n + 80)),
    ]


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # Cholesky, lower
    fit: np.ndarray
    flat: float | None = None

    @cached_property
    def inverses(self) -> list[np.ndarray]:
        """Of the factors, once for all rows: whitening is then a product."""
        return [np.linalg.inv(f) for f in self.factors]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        if self.flat is not None or not len(x):
            return np.full(len(x), self.flat if self.flat is not None else 0.5)
        z = np.column_stack([self.fit_input(x), np.ones(len(x))]) @ self.fit
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit_input(self, x: np.ndarray) -> np.ndarray:
        """The log-density difference, squashed so that far outliers can't overflow."""
        d = self.density(x, 1) - self.density(x, 0)
        return np.sign(d) * np.log1p(np.abs(d))

    def density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = self.inverses[k] @ ((x - self.centre) / self.scale - self.means[k]).T
        return -0.5 * (z * z).sum(0) - np.log(np.diag(self.factors[k])).sum()


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.2, ridge: float = 0.05) -> Model:
    none = np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Model(none, none, [], [], none, float(y.mean()) if len(y) else 0.5)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    parts = [z[y == k] for k in (0, 1)]
    means = [p.mean(0) for p in parts]
    own = [(p - m).T @ (p - m) / max(1, len(p)) for p, m in zip(parts, means, strict=True)]
    pooled = sum(len(p) * c for p, c in zip(parts, own, strict=True)) / len(z)
    factors = []
    for p, c in zip(parts, own, strict=True):
        s = shrink + (1 - shrink) * z.shape[1] / (len(p) + z.shape[1])  # few rows: nearer to the pooled covariance
        mixed = (1 - s) * c + s * pooled
        factors.append(np.linalg.cholesky(mixed + ridge * np.diag(np.diag(pooled) + 1e-3)))
    model = Model(centre, scale, means, factors, none)
    model.fit = logistic(model.fit_input(x)[:, None], y)
    return model


def vectors(docs: DataFrame) -> DataFrame:
    """(label, x) for rows (text, label)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([statistics(t.as_py()) for t in b.column(0)], pa.list_(pa.float64()))], names=["label", "x"])

    return docs.select("text", "label").mapInArrow(of, "label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, rows: int = ROWS) -> Model:
    """Fit on at most `rows` labelled rows outside the held-out fold; only their statistics reach the driver."""
    found = vectors(sample(docs, labels, label, folds, held_out, rows)).collect()
    return fit(np.array([r["x"] for r in found], float).reshape(len(found), len(NAMES)), np.array([r["label"] for r in found], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5, held_out: int = 0) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)], float).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["id", "score"])

    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(of, kind)
    out = F.coalesce(fold(F.col("id"), folds) == held_out, F.lit(False))
    return scored.select("id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs with a score of at least threshold, all columns as they were."""

    @F.pandas_udf(T.DoubleType())
    def scores(texts):
        import pandas as pd

        return pd.Series(model.scores(np.array([statistics(t) for t in texts], float).reshape(len(texts), len(NAMES))))

    return docs.filter(scores(F.col(text_col)) >= threshold)
