"""Nearest-centroid models: closed-form linear scorers fitted with one grouped aggregate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.scores import mean_of_models


def _sums(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Vector sum and row count per key, combined map-side in one array buffer per key."""
    summary = Summarizer.metrics("sum", "count").summary(array_to_vector(F.col(vector)))
    return (
        df.filter(F.col(vector).isNotNull()).groupBy(*keys).agg(summary.alias("_s"))
        .select(*keys, vector_to_array("_s.sum").alias("total"), F.col("_s.count").alias("n"))
    )


def _with_bias(model: DataFrame) -> DataFrame:
    """Score of a class is ``mu . x - |mu|^2 / 2``."""
    norm = F.aggregate("mu", F.lit(0.0), lambda acc, x: acc + x * x)
    return model.withColumn("bias", norm * -0.5)


def fit_centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """One row per class: ``(label, n, mu, bias)``."""
    sums = _sums(df, [label], vector)
    return _with_bias(sums.select(label, "n", F.transform("total", lambda x: x / F.col("n")).alias("mu")))


def fit_kfold_centroids(df: DataFrame, label: str, vector: str, fold: str = "kfold", folds: int = 5) -> DataFrame:
    """One model per held-out fold ``(fold, label, n, mu, bias)`` from a single pass over the rows.

    Sums per (class, fold) are added up once; a model is the class total minus its held-out fold.
    Everything after the first aggregate works on ``classes * folds`` rows.
    """
    per_fold = _sums(df, [label, fold], vector)
    by_class = per_fold.groupBy(label).agg(
        F.collect_list(F.struct(F.col(fold).alias("f"), "total", "n")).alias("parts"))
    summed = by_class.select(label, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), "parts")
    rest = F.filter("parts", lambda p: p["f"] != F.col("fold"))
    first = F.get(rest, F.lit(0))["total"]
    total = F.aggregate(
        F.slice(rest, 2, folds), first, lambda acc, p: F.zip_with(acc, p["total"], lambda a, b: a + b))
    count = F.aggregate(rest, F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    model = summed.select("fold", label, total.alias("total"), count.alias("n")).filter(F.col("n") > 0)
    return _with_bias(model.select("fold", label, "n", F.transform("total", lambda x: x / F.col("n")).alias("mu")))


def fit_shrunk_centroids(df: DataFrame, label: str, vector: str, classes: Sequence, settings: Sequence[tuple[float, float]]):
    """Weights ``(models, classes, dim)`` and biases of one model for each ``(strength, sharpness)``, from one pass over the rows.

    A class mean is drawn to the mean of all classes as if ``strength`` more rows lay there, so a class without rows has that
    mean; ``sharpness`` scales the scores. Only class sums leave Spark: classes by width, whatever the number of rows or models.
    """
    found = {r[label]: r for r in _sums(df.filter(F.col(label).isin(list(classes))), [label], vector).collect()}
    if not found:
        raise ValueError("no row of any of the classes")
    width = len(next(iter(found.values()))["total"])
    total = np.array([found[c]["total"] if c in found else np.zeros(width) for c in classes])
    n = np.array([found[c]["n"] if c in found else 0 for c in classes])
    strength, sharpness = (np.array(column, dtype=float)[:, None, None] for column in zip(*settings))
    means = (total + strength * (total.sum(0) / n.sum())) / (n[:, None] + strength)
    return sharpness * means, -0.5 * sharpness[:, :, 0] * (means ** 2).sum(2)


def model_arrays(model: DataFrame, label: str, classes: Sequence, fold: str | None = None):
    """Weights ``(models, classes, dim)`` and biases as numpy arrays, for shipping with a task.

    The size is fixed by the model (folds x classes x dimension), not by the data. A class that
    a model has never seen scores minus infinity.
    """
    rows = model.filter(F.col(label).isin(list(classes))).collect()
    if not rows:
        raise ValueError("the model has no row for any of the classes")
    folds = sorted({r[fold] for r in rows}) if fold else [None]
    dim = len(rows[0]["mu"])
    weights = np.zeros((len(folds), len(classes), dim))
    bias = np.full((len(folds), len(classes)), -np.inf)
    for r in rows:
        at = (folds.index(r[fold]) if fold else 0, list(classes).index(r[label]))
        weights[at], bias[at] = r["mu"], r["bias"]
    return weights, bias


def linear_logits(vector: Column, weights: np.ndarray, bias: np.ndarray) -> Column:
    """Array (models) of arrays (classes) of logits for a vector column.

    One matrix product per Arrow batch: no explode, no join and no shuffle of the vectors.
    """
    models, classes, dim = weights.shape
    flat_weights, flat_bias = weights.reshape(models * classes, dim).T.copy(), bias.reshape(-1)

    @F.arrow_udf("array<array<double>>")
    def product(vectors: pa.Array) -> pa.Array:
        present = vectors.is_valid().to_numpy(zero_copy_only=False)
        lengths = vectors.value_lengths().drop_null().to_numpy(zero_copy_only=False)
        if (lengths != dim).any():
            raise ValueError(f"vectors must have {dim} values, found {sorted(set(lengths.tolist()))[:5]}")
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        scores = pa.array((x @ flat_weights + flat_bias).reshape(-1))
        per_model = pa.ListArray.from_arrays(pa.array(np.arange(0, len(scores) + 1, classes), pa.int32()), scores)
        ends = np.concatenate([[0], np.cumsum(np.where(present, models, 0))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~present, False)), per_model)

    return product(vector.cast("array<double>"))


def score_vectors(df: DataFrame, vector: str, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """Add ``model_logits`` and their mean over the models, ``logits``."""
    scored = df.withColumn("model_logits", linear_logits(F.col(vector), weights, bias))
    return scored.withColumn("logits", mean_of_models(F.col("model_logits")))


def logits_long(df: DataFrame, key: str) -> DataFrame:
    """Long form ``(key, model, class_ix, logit)`` of ``model_logits``.

    The outer forms: the inner ones add a size filter that would run the matrix product twice.
    """
    per_model = df.select(key, F.posexplode_outer("model_logits").alias("model", "_l"))
    long = per_model.select(key, "model", F.posexplode_outer("_l").alias("class_ix", "logit"))
    return long.filter(F.col("class_ix").isNotNull())


def ensemble_mean(long: DataFrame, key: str) -> DataFrame:
    """Mean logit per row and class over models whose logits come from separate jobs."""
    return long.groupBy(key, "class_ix").agg(F.avg("logit").alias("logit"))


def softmax_long(mean: DataFrame, key: str) -> DataFrame:
    """Softmax over the classes of each row of a long logit table."""
    row = Window.partitionBy(key)
    shifted = mean.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(row)))
    return shifted.withColumn("confidence", F.col("_e") / F.sum("_e").over(row)).drop("_e")
