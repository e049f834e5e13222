"""Spark ML learners over feature vectors, one model per fold, and their storage."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    NaiveBayesModel,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.binding import let
from presswork.functions.labels import first_max
from presswork.functions.scores import cross_entropy

SEED = 411


def as_vectors(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Add the ``features`` vector and numeric ``y`` that Spark ML expects."""
    return df.withColumn("features", array_to_vector(F.col(vector))).withColumn("y", F.col(label).cast("double"))


def logistic_regression(max_iter: int = 20, reg: float = 0.01, tol: float = 1e-6) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol="y", family="multinomial", maxIter=max_iter, regParam=reg, tol=tol, standardization=False)


def perceptron(input_dim: int, hidden: list[int], classes: int, max_iter: int = 30) -> MultilayerPerceptronClassifier:
    """Feed-forward net with softmax output."""
    return MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="y", layers=[input_dim, *hidden, classes], maxIter=max_iter, seed=SEED)


def accuracy(df: DataFrame, predicted: str = "recomputed") -> float:
    return df.agg(F.avg((F.col(predicted) == F.col("y")).cast("int"))).first()[0]


def _layer(x: Column, weights: np.ndarray, bias: np.ndarray) -> Column:
    """``weights @ x + bias`` for an array column. The literals are parsed once, as constants."""
    rows = F.from_json(F.lit(json.dumps(np.column_stack([bias, weights]).tolist())), "array<array<double>>")
    dot = lambda w: F.aggregate(
        F.zip_with(x, F.slice(w, 2, weights.shape[1]), lambda a, b: a * b), F.get(w, F.lit(0)), lambda s, v: s + v)
    return F.transform(rows, dot)


def class_scores(model, features: str = "features") -> Column:
    """Class scores of a linear or perceptron model, from its weights in built-in expressions."""
    x = vector_to_array(F.col(features))
    if isinstance(model, LogisticRegressionModel):
        return _layer(x, model.coefficientMatrix.toArray(), model.interceptVector.toArray())
    weights, at, layers = model.weights.toArray(), 0, model.getLayers()
    for number, (n_in, n_out) in enumerate(zip(layers, layers[1:])):
        matrix = weights[at:at + n_in * n_out].reshape(n_in, n_out).T
        x = _layer(x, matrix, weights[at + n_in * n_out:at + (n_in + 1) * n_out])
        at += (n_in + 1) * n_out
        if number < len(layers) - 2:
            x = F.transform(x, lambda v: 1 / (1 + F.exp(-v)))
    return x


def with_recomputed(scored: DataFrame, model) -> DataFrame:
    """Add ``recomputed``, the class of the highest score computed from the model's weights."""
    return scored.withColumn("recomputed", let(class_scores(model), first_max).cast("double"))


def agreement_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key, and whether predictions and recomputed classes are the same."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.col("prediction") == F.col("recomputed")).alias("same"))


def gradient_size(model: LogisticRegressionModel, train: DataFrame) -> float:
    """Largest entry of the gradient of mean log loss plus ridge penalty, as a plain aggregate over ``train``."""
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    shape = (len(bias), weights.shape[1] + 1)
    size = shape[0] * shape[1]

    def sums(batches):
        total, n = np.zeros(shape), 0
        for batch in batches:
            x, y = np.stack(batch["x"]), batch["y"].to_numpy(int)
            scores = x @ weights.T + bias
            p = np.exp(scores - scores.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            total[:, 0] += p.sum(0)
            total[:, 1:] += p.T @ x
            n += len(y)
        yield pd.DataFrame({"i": np.arange(size + 1), "v": np.append(total.ravel(), n)})

    # one matrix per task, summed by place: what comes to the driver is one matrix
    rows = train.select(vector_to_array("features").alias("x"), "y").mapInPandas(sums, "i int, v double")
    flat = np.zeros(size + 1)
    for row in rows.groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[row["i"]] = row["v"]
    gradient = flat[:-1].reshape(shape) / max(flat[-1], 1)
    gradient[:, 1:] += model.getRegParam() * model.coefficientMatrix.toArray()
    return float(np.abs(gradient).max())


def beats_class_shares(model, train: DataFrame) -> bool:
    """Whether the mean log loss lies below that of predicting the class shares."""
    loss = train.select(cross_entropy(class_scores(model), F.col("y").cast("int")).alias("l")).agg(F.avg("l")).first()[0]
    counts = [r["count"] for r in train.groupBy("y").count().collect()]
    n = sum(counts)
    return loss < -sum(c / n * math.log(c / n) for c in counts)


def text_bayes(train: DataFrame, label_code: str, counts: str = "features") -> NaiveBayesModel:
    """Naive Bayes as a Spark ML model over hashed word counts (``features.hashed_counts``).

    Every word counts in its bucket, and nothing that grows with the vocabulary is on the driver.
    """
    return NaiveBayes(featuresCol=counts, labelCol=label_code, smoothing=1.0).fit(train)


def cross_validate(df: DataFrame, estimator: Estimator, grid: list | None = None, fold: str = "kfold",
                   folds: int = 5, parallelism: int = 2):
    """Cross-validation on given folds; keeps the model of every fold."""
    validator = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid or ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"),
        numFolds=folds, foldCol=fold, parallelism=parallelism, collectSubModels=True, seed=SEED,
    )
    return validator.fit(df)


def tune(train: DataFrame, validation: DataFrame, estimator: Estimator, grid: list) -> list[tuple[int, float, object]]:
    """Fit every parameter map on ``train`` and score it on ``validation`` (never on the test set)."""
    evaluator = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    return [
        (number, evaluator.evaluate(model.transform(validation)), model)
        for number, model in estimator.fitMultiple(train, grid)
    ]


def save_fold_models(models: list, path: str) -> None:
    for fold, model in enumerate(models):
        model.write().overwrite().save(f"{path}/fold={fold}")


def load_fold_models(path: str, folds: int = 5) -> list[LogisticRegressionModel]:
    return [LogisticRegressionModel.load(f"{path}/fold={fold}") for fold in range(folds)]
