"""Training by epochs over embeddings. Iterative, so without SQL; the tests hold trainer and brackets against plain versions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from presswork.functions.text import stable_uniform
from presswork.operators import shaping, trainer, training_log
from presswork.plans.registry import query, table
from presswork.session import scratch_path

DIM, CLASSES, BATCHES = 64, 10, 4
EPOCHS = 5
TRIALS = 27
RATE, DECAY = (0.05, 20.0), (1e-6, 1e-2)


def _batches(spark, sf_dir) -> trainer.Batches:
    folded = shaping.stratified_kfold(table(spark, sf_dir, "embeddings"), "label", "vec_id")
    return trainer.deal_batches(folded, "vec_id", "embedding", "label", "kfold", BATCHES, CLASSES, DIM)


@query("train_epochs")
def train_epochs(spark, sf_dir):
    """One model per fold: metrics of each epoch from the trainer's own log, and whether it is the fold's best."""
    path = scratch_path(spark, "epochs")
    trainer.train_epochs(_batches(spark, sf_dir), [trainer.Trial(f, f, rate=5.0, decay=1e-4) for f in range(5)], path, EPOCHS, EPOCHS)
    log = trainer.epoch_log(spark, path).withColumnRenamed("trial", "fold")
    trained = training_log.metrics_of_batches(log.filter("batch is not null"), ["fold", "epoch"])
    held = training_log.metrics_of_batches(log.filter("batch is null"), ["fold", "epoch"]).select(
        "fold", "epoch", F.col("n_rows").alias("n_valid"), F.col("accuracy").alias("valid_accuracy"), F.col("loss").alias("valid_loss"))
    best = training_log.best_epoch_per_fold(held, "fold", "epoch", "valid_accuracy").select("fold", "best_epoch")
    every = trained.join(held, ["fold", "epoch"]).join(best, "fold", "left")
    return every.select("fold", "epoch", "n_rows", "n_valid", *[F.round(c, 6).alias(c) for c in ("accuracy", "loss", "valid_accuracy", "valid_loss")],
                        F.coalesce(F.col("epoch") == F.col("best_epoch"), F.lit(False)).alias("is_best"))


def linear_space(trials, number="number"):
    """A reproducible draw of rate and decay for each trial number, even on a logarithmic scale."""
    def draw(name, low, high):
        u = stable_uniform(F.concat(F.col(number).cast("string"), F.lit(f":{name}")))
        return F.exp(F.lit(math.log(low)) + u * math.log(high / low)).alias(name)

    return trials.select(number, draw("rate", *RATE), draw("decay", *DECAY))


@query("hyperband")
def hyperband(spark, sf_dir):
    """Trials of a linear model over the embeddings, in three brackets, judged by the rows of the first fold."""
    trials = linear_space(spark.range(TRIALS).withColumnRenamed("id", "number"))
    run = trainer.hyperband(_batches(spark, sf_dir), trials, scratch_path(spark, "hyperband"), fold=0)
    return run.withColumns({c: F.round(c, 6) for c in ("loss", "accuracy")})
