"""From logits to labels, confidences and comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.labels import first_max, label_decode
from presswork.functions.scores import softmax


def predicted_label(logits: Column, classes: Sequence[str]) -> Column:
    """Class of the highest score; the lowest class code wins a tie."""
    return label_decode(first_max(logits), classes)


def confidence_wide(df: DataFrame, keys: list[str], logits: str, classes: Sequence[str]) -> DataFrame:
    """One column of softmax confidence per class."""
    scored = df.select(*keys, softmax(F.col(logits)).alias("_p"))
    return scored.select(*keys, *[F.get("_p", F.lit(i)).alias(str(c)) for i, c in enumerate(classes)])


def confidence_long(wide: DataFrame, keys: list[str], classes: Sequence[str]) -> DataFrame:
    """Wide confidences to ``(Label, Confidence)`` rows."""
    return wide.unpivot(keys, [str(c) for c in classes], "Label", "Confidence")


def compare_predictions(long: DataFrame, key: str, models: Sequence[str]) -> DataFrame:
    """``(key, model, label)`` rows of separate jobs to one column per model and a flag of full agreement."""
    return with_agreement(long.groupBy(key).pivot("model", list(models)).agg(F.first("label")), models)


def with_agreement(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Flag the rows in which all model columns agree."""
    agree = reduce(lambda a, b: a & b, [F.col(m) == F.col(models[0]) for m in models[1:]], F.lit(True))
    return wide.withColumn("agree", agree)
