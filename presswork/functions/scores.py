"""Expressions over an array of class scores (one value per class, class order fixed)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions.binding import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    """Softmax with the maximum shifted out."""
    def normalised(exps: Column) -> Column:
        return let(_sum(exps), lambda total: F.transform(exps, lambda x: x / total))

    def shifted(peak: Column) -> Column:
        return let(F.transform(logits, lambda x: F.exp(x - peak)), normalised)

    return let(F.array_max(logits), shifted)


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log softmax of the target class."""
    def loss(peak: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - peak))
        return peak + F.log(total) - F.get(logits, target)

    return let(F.array_max(logits), loss)


def mean_of_models(per_model: Column) -> Column:
    """Element-wise mean of an array of logit arrays (one per model)."""
    first = F.get(per_model, F.lit(0))
    total = F.aggregate(
        F.slice(per_model, 2, F.size(per_model)), first,
        lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b),
    )
    return F.transform(total, lambda x: x / F.size(per_model))
