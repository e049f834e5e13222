"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text is reduced to a vector of statistics (lengths as logarithms, shares as square roots). Each
class has its mean and a covariance shrunk towards the pooled one and towards a diagonal. A text's
raw score is the difference of the two log densities, from Mahalanobis distances solved with Cholesky
factors that are computed once per model. A two-parameter logistic curve, fitted on the training
differences, turns it into a probability.

Class counts, sums and products are sums over all labelled rows, made by Spark; the driver sees only
class-by-statistic matrices and a histogram of differences with a fixed number of bins.

Null and empty texts are scored as texts of length 0. A document labelled more than once counts once,
with the label most of its rows bear (ties: 0); labels other than 0 and 1 and null keys are ignored.
A class with no labelled row makes every score the smoothed share of label 1. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import append_from_text, filter_rows, ship_code
from presswork.session import materialise

STATISTICS = (
    "bytes", "words", "word_length", "distinct_words", "repeated_words", "upper", "digits", "space", "stops", "symbols",
    "bars", "non_ascii", "lines", "repeated_lines", "long_words", "word_share",
)
SHRINK_POOLED = 0.3
SHRINK_DIAGONAL = 0.1
THRESHOLD = 0.7
BINS = 2048

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_STOPS = np.isin(_BYTES, list(b".,;:'\"()-"))
_HIGH = _BYTES >= 128
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _STOPS | _HIGH)


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(len(data), 1)
    share = [int(counts[m].sum()) / size for m in (_UPPER, _DIGIT, _SPACE, _STOPS, _SYMBOL, _BYTES == 124, _HIGH)]
    words = text.split()
    n = max(len(words), 1)
    lengths = list(map(len, words))
    repeats = sum(map(eq, words, words[1:])) / n
    lines = text.split("\n")
    plain = sum(map(str.isalpha, (w.rstrip(".,;:!?") for w in words))) / n
    root = np.sqrt
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(sum(lengths) / n), root(len(set(words)) / n), root(repeats),
        root(share[0]), root(share[1]), root(share[2]), root(share[3]), root(share[4]), root(share[5]), root(share[6]),
        np.log1p(len(lines)), root(1 - len(set(lines)) / len(lines)), root(sum(x > 25 for x in lengths) / n), root(plain),
    ]


def with_statistics(docs: DataFrame, text: str = "text", name: str = "statistics", drop_text: bool = False) -> DataFrame:
    return append_from_text(docs, text, f"`{name}` array<double>", lambda: lambda ts: [[statistics(t) for t in ts]], drop_text)


@dataclass
class QuadraticModel:
    means: np.ndarray  # class, statistic
    factors: np.ndarray  # class, lower Cholesky factor
    log_weights: np.ndarray  # class: log share less half the log determinant
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None  # where a class has no rows

    @classmethod
    def from_moments(cls, n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink_pooled: float = SHRINK_POOLED,
                     shrink_diagonal: float = SHRINK_DIAGONAL) -> QuadraticModel:
        """Model from each class's row count, sums of statistics and sums of their products."""
        d = sums.shape[1]
        share = (n[1] + 1) / (n.sum() + 2)
        if (n < 1).any():
            return cls(np.zeros((2, d)), np.tile(np.eye(d), (2, 1, 1)), np.zeros(2), constant=float(share))
        means = sums / n[:, None]
        scatter = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(0) / max(n.sum() - 2, 1)
        pooled += np.diag(np.diag(pooled) * 1e-6 + 1e-6)
        factors = []
        for k in range(2):
            # few rows lean more on the pooled covariance
            own = (1 - shrink_pooled) * (n[k] - 1) / (n[k] - 1 + d)
            cov = own * scatter[k] / max(n[k] - 1, 1) + (1 - own) * pooled
            cov = (1 - shrink_diagonal) * cov + shrink_diagonal * np.diag(np.diag(cov))
            factors.append(np.linalg.cholesky(cov))
        factors = np.array(factors)
        log_det = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1)
        return cls(means, factors, np.log(n / n.sum()) - log_det / 2)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 less that of label 0, one per row of ``x``."""
        logs = []
        for k in range(2):
            z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
            logs.append(self.log_weights[k] - (z * z).sum(0) / 2)
        return logs[1] - logs[0]

    def squashed(self, x: np.ndarray) -> np.ndarray:
        """Differences with their far tails drawn in, in the same order."""
        return np.arcsinh(self.difference(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.squashed(x) + self.shift, -500, 500)))

    def calibrate(self, z: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        """Logistic curve through binned squashed differences (Newton steps with a small ridge)."""
        a = np.stack([z, np.ones_like(z)], 1)
        w, total = np.array([1.0, 0.0]), zeros + ones
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
            gradient = a.T @ (total * p - ones) + 0.1 * (w - [1.0, 0.0])
            hessian = (a * (total * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            w = w - np.clip(step, -1, 1)
            if abs(step).max() < 1e-9:
                break
        self.slope, self.shift = max(float(w[0]), 0.05), float(w[1])


def labelled(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(label, statistics) of the rows (key, statistics) that have a label. Narrow rows meet the labels, not texts."""
    named = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label"))
    one = named.where("_key is not null and _label in (0, 1)").groupBy("_key").agg(F.avg("_label").alias("_share"))
    chosen = rows.select(F.col(key).alias("_key"), "statistics").where("_key is not null").dropDuplicates(["_key"])
    return chosen.join(one, "_key").select(F.when(F.col("_share") > 0.5, 1).otherwise(0).alias("label"), "statistics")


def fit(rows: DataFrame, shrink_pooled: float = SHRINK_POOLED, shrink_diagonal: float = SHRINK_DIAGONAL) -> QuadraticModel:
    """Fit on rows (label, statistics); they are stored, as they are read for the moments and for the curve."""
    ship_code(rows.sparkSession)
    rows = materialise(rows, "labelled")
    d = len(STATISTICS)

    def moments(frames):
        n, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for frame in frames:
            y = frame["label"].to_numpy()
            x = np.array(frame["statistics"].tolist(), float).reshape(len(y), d)
            for k in range(2):
                part = x[y == k]
                n[k] += len(part)
                sums[k] += part.sum(0)
                products[k] += part.T @ part
        for k in range(2):
            flat = np.concatenate([[n[k]], sums[k], products[k].ravel()])
            yield pd.DataFrame({"label": k, "i": np.arange(len(flat)), "v": flat})

    parts = rows.mapInPandas(moments, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v"))
    flat = np.zeros((2, 1 + d + d * d))
    for r in parts.collect():  # two classes by a fixed number of statistics
        flat[r["label"], r["i"]] = r["v"]
    model = QuadraticModel.from_moments(flat[:, 0], flat[:, 1:1 + d], flat[:, 1 + d:].reshape(2, d, d), shrink_pooled, shrink_diagonal)
    if model.constant is not None:
        return model

    def bins(frames):
        counts = np.zeros((2, BINS), np.int64)
        for frame in frames:
            y = frame["label"].to_numpy()
            z = model.squashed(np.array(frame["statistics"].tolist(), float).reshape(len(y), d))
            at = np.clip(((z + 32) * BINS / 64).astype(int), 0, BINS - 1)
            for k in range(2):
                counts[k] += np.bincount(at[y == k], minlength=BINS)
        at = np.flatnonzero(counts.sum(0))
        yield pd.DataFrame({"bin": at, "zeros": counts[0, at], "ones": counts[1, at]})

    hist = rows.mapInPandas(bins, "bin int, zeros long, ones long").groupBy("bin").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toPandas()  # at most BINS rows
    model.calibrate((hist["bin"].to_numpy() + 0.5) * 64 / BINS - 32, hist["zeros"].to_numpy(float), hist["ones"].to_numpy(float))
    return model


def add_scores(docs: DataFrame, model: QuadraticModel, text: str = "text", name: str = "score", drop_text: bool = False) -> DataFrame:
    """Add the score of every whole text. No shuffle."""

    def make():
        return lambda texts: [model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))).tolist()]

    return append_from_text(docs, text, f"`{name}` double", make, drop_text)


def score_statistics(rows: DataFrame, model: QuadraticModel, name: str = "score") -> DataFrame:
    """Add the score to rows that carry ``statistics``, which are dropped."""
    ship_code(rows.sparkSession)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), float).reshape(-1, len(STATISTICS))))

    return rows.withColumn(name, score("statistics")).drop("statistics")


def accepted(docs: DataFrame, model: QuadraticModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents whose score reaches ``threshold``, with their own columns; all of them where the model has seen one class
    or none."""
    if model.constant is not None:
        return docs
    return filter_rows(docs, lambda rows, names: add_scores(rows, model, names[text]).where(F.col("score") >= threshold))
