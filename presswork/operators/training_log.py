"""Metrics of a training run kept as a table of examples ``(fold, epoch, batch, correct, loss)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.operators.scale import prefix_scan


def best_epoch_per_fold(epochs: DataFrame, fold: str, epoch: str, score: str) -> DataFrame:
    """Earliest epoch with the highest score; a score must beat 0 to count."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(epoch)).alias("e")))
    return (
        epochs.filter(F.col(score) > 0).groupBy(fold).agg(best.alias("b"))
        .select(fold, (-F.col("b.e")).alias("best_epoch"), F.col("b.s").alias("best_score"))
    )


def running_accuracy(log: DataFrame, batch: str, correct: str, loss: str, batch_size: int = 16,
                     every: int = 1000) -> DataFrame:
    """Every ``every`` batches: that batch's mean loss and accuracy so far.

    Accuracy divides by ``(batch + 1) * batch_size``, so a short last batch is counted as full.
    """
    batches = log.groupBy(batch).agg(F.sum(correct).alias("_hits"), F.avg(loss).alias("loss"))
    scanned = prefix_scan(batches, [batch], sums={"_so_far": "_hits"})
    return scanned.filter(F.col(batch) % every == 0).select(
        batch, "loss", (F.col("_so_far") / ((F.col(batch) + 1) * batch_size)).alias("accuracy"))


def epoch_metrics(log: DataFrame, keys: list[str], batch: str, correct: str, loss: str) -> DataFrame:
    """Accuracy over rows, loss as mean of batch means, and the row mean next to it."""
    batches = log.groupBy(*keys, batch).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(correct).alias("hits"), F.sum(loss).alias("loss"))
    return metrics_of_batches(batches, keys)


def metrics_of_batches(batches: DataFrame, keys: list[str]) -> DataFrame:
    """``epoch_metrics`` of a log with one row per batch: its rows, hits and summed loss. Batches without rows do not count."""
    return batches.filter("n_rows > 0").groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        (F.sum("hits") / F.sum("n_rows")).alias("accuracy"),
        F.avg(F.col("loss") / F.col("n_rows")).alias("loss"),
        (F.sum("loss") / F.sum("n_rows")).alias("row_loss"),
    )
