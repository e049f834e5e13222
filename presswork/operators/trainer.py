"""Softmax classifiers trained by epochs of mini-batches, many trials side by side, with a stored log.

Rows stay where Spark puts them: a step is one job over one stored batch of rows, whose tasks return summed gradients. What the
driver holds are the weights, one matrix of classes by width for each trial, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.functions.text import stable_hash, stable_uniform
from presswork.operators.tuning import halving_rung
from presswork.session import scratch_path

GROUP_BYTES = 16 << 20  # weights that one job carries; more trials are dealt over several jobs
MAX_NORM = 1.0  # fixed value: longest gradient
STATE = "trial int, batch int, n_rows bigint, hits bigint, loss double, weights array<double>"


@dataclass(frozen=True)
class Trial:
    """One model: it trains on the rows outside its fold and is judged on those inside."""

    number: int
    fold: int
    rate: float
    decay: float = 0.0


@dataclass
class Batches:
    """Training rows ``(x, y, fold)`` stored by batch."""

    rows: DataFrame
    count: int
    classes: int
    width: int


def deal_batches(df: DataFrame, key: str, vector: str, label: str, fold: str, batches: int, classes: int, width: int) -> Batches:
    """Deal rows to batches by a hash of their key and store them, so that a step reads its own batch only.

    Rows without a vector, label or fold, with another width, or with a label outside ``range(classes)`` are not trained on.
    """
    usable = F.col("fold").isNotNull() & (F.size("x") == width) & F.col("y").between(0, classes - 1)
    rows = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("fold"),
                     (stable_hash(F.col(key)) % batches).cast("int").alias("batch")).filter(usable & F.forall("x", lambda v: v.isNotNull()))
    path = scratch_path(df.sparkSession, "batches")
    rows.write.partitionBy("batch").parquet(path)
    return Batches(df.sparkSession.read.schema("x array<double>, y int, fold int, batch int").parquet(path), batches, classes, width)


def _sums(rows: DataFrame, weights: np.ndarray, folds: np.ndarray, held_out: bool) -> np.ndarray:
    """Per trial: number of rows, hits, summed log loss and, unless ``held_out``, the summed gradient."""
    n_trials, classes, size = weights.shape
    places = 3 if held_out else 3 + classes * size

    def sums(frames):
        total = np.zeros((n_trials, places))
        for frame in frames:
            n = len(frame)
            if not n:
                continue
            x, y = np.column_stack([np.ones(n), np.stack(frame["x"])]), frame["y"].to_numpy()
            scores = (x @ weights.reshape(-1, size).T).reshape(n, n_trials, classes)
            hits = scores.argmax(2) == y[:, None]
            scores -= scores.max(2, keepdims=True)
            p = np.exp(scores)
            norm = p.sum(2, keepdims=True)
            loss = np.log(norm[:, :, 0]) - scores[np.arange(n), :, y]
            counted = (frame["fold"].to_numpy()[:, None] == folds) == held_out
            total[:, 0] += counted.sum(0)
            total[:, 1] += (hits & counted).sum(0)
            total[:, 2] += (loss * counted).sum(0)
            if not held_out:
                p /= norm
                p[np.arange(n), :, y] -= 1
                p *= counted[:, :, None]
                total[:, 3:] += (p.reshape(n, -1).T @ x).reshape(n_trials, -1)
        at = np.arange(total.size)
        yield pd.DataFrame({"trial": at // places, "place": at % places, "v": total.ravel()})

    summed = np.zeros((n_trials, places))
    parts = rows.select("x", "y", "fold").mapInPandas(sums, "trial int, place int, v double")
    for r in parts.groupBy("trial", "place").agg(F.sum("v").alias("v")).collect():
        summed[r["trial"], r["place"]] = r["v"]
    return summed


def _grouped_sums(rows: DataFrame, weights: np.ndarray, trials: list[Trial], held_out: bool) -> np.ndarray:
    folds = np.array([t.fold for t in trials])
    step = max(1, GROUP_BYTES // max(weights[:1].nbytes, 1))
    return np.concatenate([_sums(rows, weights[i:i + step], folds[i:i + step], held_out) for i in range(0, len(trials), step)])


def _stored(spark: SparkSession, path: str, epoch: int) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={epoch}/_SUCCESS")
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def _weights(spark: SparkSession, path: str, epoch: int, trials: list[Trial], shape: tuple) -> np.ndarray:
    if not epoch:
        return np.zeros(shape)
    kept = spark.read.schema(STATE).parquet(f"{path}/epoch={epoch}").filter("batch is null").select("trial", "weights").collect()
    found = {r["trial"]: r["weights"] for r in kept}
    return np.array([found[t.number] for t in trials]).reshape(shape)


def train_epochs(data: Batches, trials: list[Trial], path: str, until: int, planned: int) -> None:
    """Train the trials side by side up to epoch ``until``; an epoch is stored when it ends, and stored epochs are not run again.

    A step subtracts the mean gradient plus ``decay`` times the weights (not the bias), no longer than ``MAX_NORM``, times a
    rate that falls linearly from ``rate`` to 0 over the ``planned`` epochs. Below ``path`` each epoch leaves one row per
    trial and batch (rows, hits and summed loss before the step) and, with a null batch, the same for the rows held out after
    the epoch, with the weights. A run that was broken off goes on after its last whole epoch.
    """
    spark = data.rows.sparkSession
    shape = (len(trials), data.classes, data.width + 1)
    done = max((e for e in range(1, until + 1) if _stored(spark, path, e)), default=0)
    if not trials or done >= until:
        return
    weights = _weights(spark, path, done, trials, shape)
    rates, decays = (np.array([getattr(t, name) for t in trials]) for name in ("rate", "decay"))
    for epoch in range(done + 1, until + 1):
        log = []

        def note(batch, sums, kept=None):
            for i, t in enumerate(trials):
                log.append((t.number, batch, int(sums[i, 0]), int(sums[i, 1]), float(sums[i, 2]), None if kept is None else kept[i].ravel().tolist()))

        for batch in range(data.count):
            sums = _grouped_sums(data.rows.filter(F.col("batch") == batch), weights, trials, held_out=False)
            note(batch, sums)
            gradient = sums[:, 3:].reshape(shape) / np.maximum(sums[:, 0], 1)[:, None, None]
            gradient[:, :, 1:] += decays[:, None, None] * weights[:, :, 1:]
            norm = np.sqrt((gradient ** 2).sum((1, 2)))
            gradient *= (MAX_NORM / np.maximum(norm, MAX_NORM))[:, None, None]
            left = 1 - ((epoch - 1) * data.count + batch) / (planned * data.count)
            weights = weights - (rates * left)[:, None, None] * gradient
        note(None, _grouped_sums(data.rows, weights, trials, held_out=True), weights)
        spark.createDataFrame(log, STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def epoch_log(spark: SparkSession, path: str) -> DataFrame:
    """``(trial, epoch, batch, n_rows, hits, loss)``; the rows with a null batch are those held out."""
    return spark.read.schema(f"{STATE}, epoch int").parquet(path).drop("weights")


def brackets(budget: int, eta: int) -> list[int]:
    """Shares of trials by bracket; bracket s has its first rung after ``budget / eta ** s`` epochs."""
    top, least = 0, budget
    while least % eta == 0:
        top, least = top + 1, least // eta
    return [-(-(top + 1) * eta ** s // (s + 1)) for s in range(top + 1)]


def bracket_of(number: Column, shares: list[int]) -> Column:
    """Bracket of a trial, drawn from its number in proportion to ``shares``."""
    u, below, found = stable_uniform(F.concat(number.cast("string"), F.lit(":bracket"))) * sum(shares), 0, None
    for s, share in enumerate(shares):
        below += share
        found = F.when(u < below, s) if found is None else found.when(u < below, s)
    return found.otherwise(len(shares) - 1).cast("int")


def hyperband(data: Batches, trials: DataFrame, path: str, fold: int, budget: int = 9, eta: int = 3) -> DataFrame:
    """Train ``trials`` (number, rate, decay) in brackets; ``fold`` names the rows that judge them.

    All brackets advance together, and all trials left take part in the same jobs. Bracket s has rungs after ``budget / eta ** s``
    epochs, and every ``eta`` times as many: there the trials up to the held-out loss of rank ``ceil(n / eta)`` go on, from the weights
    they have, others stop; without rows to judge by none goes on. Returns one row per trial and epoch: its bracket, held-out rows, loss and accuracy, and
    the state in which the trial ended.
    """
    spark = data.rows.sparkSession
    shares = brackets(budget, eta)
    settings = trials.select("number", "rate", "decay", bracket_of(F.col("number"), shares).alias("bracket")).orderBy("number").collect()
    dealt = {r["number"]: r["bracket"] for r in settings}
    alive = [Trial(r["number"], fold, r["rate"], r["decay"]) for r in settings]
    listed = spark.createDataFrame(settings, "number bigint, rate double, decay double, bracket int")
    if not alive:
        return listed.selectExpr("number", "bracket", "0 epoch", "0L n_rows", "0d loss", "0d accuracy", "'' state").limit(0)

    def judged() -> DataFrame:
        log = epoch_log(spark, path).filter("batch is null").withColumnRenamed("trial", "number")
        own = log.select(F.col("number").cast("bigint").alias("number"), "epoch", "n_rows", F.try_divide("loss", "n_rows").alias("loss"),
                         F.try_divide("hits", "n_rows").alias("accuracy"))
        return own.join(F.broadcast(listed), "number")

    rungs = {budget // eta ** s for s in range(1, len(shares))}
    for epoch in range(1, budget + 1):
        train_epochs(data, alive, path, epoch, budget)
        if epoch in rungs:
            at = judged().filter(F.col("epoch") == epoch).filter(F.lit(budget) / F.pow(F.lit(eta), "bracket") <= epoch)
            kept = {r["number"] for r in halving_rung(at.select("bracket", "loss", "number"), "bracket", "loss", "number", eta).collect()}
            alive = [t for t in alive if t.number in kept or budget // eta ** dealt[t.number] > epoch]
    whole = F.max("epoch").over(Window.partitionBy("number")) == budget
    return judged().withColumn("state", F.when(whole, "COMPLETE").otherwise("PRUNED")).select(
        "number", "bracket", "epoch", "n_rows", "loss", "accuracy", "state")
