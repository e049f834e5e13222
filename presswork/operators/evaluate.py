"""Reports. All of them start from one map-side combined count of (true, predicted) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1_score", "support")


def pair_counts(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., y_true, y_pred, n)``: classes squared rows, whatever the size of the input."""
    return df.groupBy(*by, F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def accuracy(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    hit = F.count(F.when(F.col(truth) == F.col(predicted), 1))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.try_divide(hit, F.count(F.lit(1))).alias("accuracy"))


def confusion_long(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Every (true, predicted) pair of the class list with its count, zero where unseen."""
    names = F.array(*[F.lit(c) for c in classes])
    grid = (
        pairs.sparkSession.range(1)
        .select(F.explode(names).alias("y_true"))
        .select("y_true", F.explode(names).alias("y_pred"))
    )
    return grid.join(pairs, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_matrix(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Rows true, one column per predicted class."""
    return confusion_long(pairs, classes).groupBy("y_true").pivot("y_pred", list(classes)).agg(F.sum("n"))


def class_report(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as true or predicted; 0/0 is 0.

    Each count feeds its true class and its predicted class in a single aggregation.
    """
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed"), hit.alias("tp")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("tp")),
    )
    sums = (
        pairs.select(*by, F.explode(sides).alias("s")).groupBy(*by, "s.label")
        .agg(F.sum("s.actual").alias("support"), F.sum("s.guessed").alias("guessed"), F.sum("s.tp").alias("tp"))
    )
    scored = sums.select(
        *by, "label", "tp", "support",
        _ratio(F.col("tp"), F.col("guessed")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.select(*by, "label", *METRICS[:2], _ratio(2 * p * r, p + r).alias("f1_score"),
                         F.col("support").cast("double").alias("support"), "tp")


def summary_rows(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``accuracy`` (same value in all columns), ``macro avg`` and ``weighted avg`` of class rows."""
    total = F.sum("support")
    values = {
        "accuracy": [F.sum("tp") / total] * 4,
        "macro avg": [F.avg(m) for m in METRICS[:3]] + [total],
        "weighted avg": [F.sum(F.col(m) * F.col("support")) / total for m in METRICS[:3]] + [total],
    }
    lines = F.array(*[
        F.struct(F.lit(name).alias("label"), *[v.alias(m) for m, v in zip(METRICS, columns)])
        for name, columns in values.items()
    ])
    return rows.groupBy(*by).agg(lines.alias("l")).select(*by, F.inline("l"))


def class_report_full(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class rows followed by the three summary rows."""
    rows = class_report(pairs, by)
    return rows.drop("tp").unionByName(summary_rows(rows, by))


def misclassified(df: DataFrame, key: str, truth: str = "y_true", predicted: str = "y_pred", n: int = 15) -> DataFrame:
    """The first ``n`` wrong predictions by key, with their own texts."""
    return df.filter(F.col(truth) != F.col(predicted)).orderBy(key).limit(n)


def model_comparison(summary: DataFrame, model: str = "model") -> DataFrame:
    """One formatted line per model: weighted precision, recall, F1, and accuracy, as percentages."""
    def share(label: str, metric: str) -> Column:
        value = F.max(F.when(F.col("label") == label, F.col(metric)))
        return F.format_string("%.2f%%", F.round(value * 100, 2))

    return summary.groupBy(model).agg(
        share("weighted avg", "precision").alias("Precision"),
        share("weighted avg", "recall").alias("Recall"),
        share("weighted avg", "f1_score").alias("F1_Score"),
        share("accuracy", "precision").alias("Accuracy"),
    )


def report_compare(reports: DataFrame, names: Sequence[str], model: str = "model") -> DataFrame:
    """Reports of several models side by side, one row per label; a label that a model does not
    have is null there. One aggregation instead of a full outer join per model."""
    return reports.groupBy("label").agg(*[
        F.max(F.when(F.col(model) == name, F.col(m))).alias(f"{name}_{m}") for name in names for m in METRICS
    ])
