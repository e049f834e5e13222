"""Hyper-parameter search tables: random trials, pruning rungs, history, best trial."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.text import stable_uniform
from presswork.operators.scale import lookup_join, prefix_scan, with_position
from presswork.session import materialise

# Bounds of the search space as (low, high, step).
LSTM_UNITS_1 = (64, 512, 32)
LSTM_UNITS_2_STEP = 32
DENSE_UNITS = (64, 512, 32)
DROPOUT_RATE = (0.2, 0.5, 0.1)
LEARNING_RATE = (1e-5, 1e-2)
EPOCHS = (10, 30, 10)
BATCH_SIZE = (64, 256, 32)

COMPLETE = "COMPLETE"
PARAMETERS = (
    "lstm_units_1", "lstm_units_2", "dense_units", "dropout_rate", "learning_rate", "epochs", "batch_size",
)


def _draw(number: Column, name: str) -> Column:
    return stable_uniform(F.concat_ws(":", number, F.lit(name)))


def _stepped(u: Column, low: Column, high: Column, step: int) -> Column:
    steps = F.floor((high - low) / step) + 1
    return (low + F.floor(u * steps) * step).cast("int")


def search_space(trials: DataFrame, number: str = "number", keep: tuple[str, ...] = ()) -> DataFrame:
    """A reproducible random draw of every parameter for each trial number; ``keep`` names columns to carry along.

    The second layer lies between half of the first layer's size and that size.
    """
    def stepped(name: str, bounds: tuple) -> Column:
        low, high, step = bounds
        return _stepped(_draw(F.col(number), name), F.lit(low), F.lit(high), step).alias(name)

    low, high, step = DROPOUT_RATE
    levels = round((high - low) / step) + 1
    dropout = F.round(F.lit(low) + F.floor(_draw(F.col(number), "dropout_rate") * levels) * step, 1)
    log_low, log_high = math.log(LEARNING_RATE[0]), math.log(LEARNING_RATE[1])
    rate = F.exp(F.lit(log_low) + _draw(F.col(number), "learning_rate") * (log_high - log_low))
    first = trials.select(
        number, *keep, stepped("lstm_units_1", LSTM_UNITS_1), stepped("dense_units", DENSE_UNITS),
        dropout.alias("dropout_rate"), rate.alias("learning_rate"), stepped("epochs", EPOCHS),
        stepped("batch_size", BATCH_SIZE),
    )
    half = F.floor(F.col("lstm_units_1") / 2)
    second = _stepped(_draw(F.col(number), "lstm_units_2"), half, F.col("lstm_units_1"), LSTM_UNITS_2_STEP)
    return first.withColumn("lstm_units_2", second).select(number, *keep, *PARAMETERS)


def halving_rung(log: DataFrame, rung: str, loss: str, number: str, eta: int = 3) -> DataFrame:
    """Trials that survive a rung: loss rank within ``ceil(n / eta)``, ties at the limit kept.

    The limit of each rung is read off a distributed sort; the trials are then a plain filter.
    """
    placed = with_position(log.select(rung, loss, number), rung, loss, number)
    sizes = placed.groupBy(rung).agg(F.min("pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    ranked = lookup_join(placed, sizes, [rung], spread=[number], how="inner")
    last = F.col("_start") + F.ceil(F.col("_n") / eta) - 1
    limits = ranked.filter(F.col("pos") == last).select(rung, F.col(loss).alias("_limit"))
    return (
        lookup_join(log, limits, [rung], spread=[number], how="inner")
        .filter(F.col(loss) <= F.col("_limit")).drop("_limit")
    )


def judged_halving(judge: Callable[[DataFrame | None, Any], DataFrame], rungs: Sequence, rung: str, loss: str, number: str,
                   eta: int = 3) -> DataFrame:
    """Reports ``(number, rung, loss)`` of the trials that reach each rung, with ``survives``.

    ``judge(trials, step)`` gives ``(number, loss)`` of the trials whose numbers it is handed (None: of all trials, for the first rung).
    A trial that a rung stops is never judged again, so a judge that fits models fits those of survivors only.
    """
    entered, done = None, []
    for step in rungs:
        own = materialise(judge(entered, step).select(number, F.lit(step).alias(rung), loss), "rung")
        kept = materialise(halving_rung(own, rung, loss, number, eta).select(number), "survivors")
        done.append(own.join(kept.withColumn("survives", F.lit(True)), number, "left"))
        entered = kept
    every = reduce(lambda a, b: a.unionByName(b), done)
    return every.withColumn("survives", F.coalesce("survives", F.lit(False)))


def successive_halving(reports: DataFrame, rungs: Sequence, rung: str, loss: str, number: str, eta: int = 3) -> DataFrame:
    """``judged_halving`` of reports ``(number, rung, loss)`` that are all at hand.

    Every trial enters the first rung; only survivors of a rung carry on to the next. One pass per
    rung, over as many trials as are left.
    """
    def listed(entered: DataFrame | None, step: Any) -> DataFrame:
        own = reports.filter(F.col(rung) == step)
        return own if entered is None else own.join(entered, number, "left_semi")

    return judged_halving(listed, rungs, rung, loss, number, eta)


RATE_BINS = 16
SMOOTHING = {-2: 1, -1: 2, 0: 3, 1: 2, 2: 1}  # ninths of a trial that count for the bins around its own


def parameter_bins(trials: DataFrame, *keep: str) -> DataFrame:
    """One row ``(param, bin)`` per trial and parameter: steps of the search space, the rate in bins of equal ratio and the second
    layer in sixteenths of its own range."""
    def steps(name: str, bounds: tuple) -> Column:
        low, _, step = bounds
        return F.round((F.col(name) - low) / step).cast("int")

    log_low, log_high = math.log(LEARNING_RATE[0]), math.log(LEARNING_RATE[1])
    rate = F.floor((F.log("learning_rate") - log_low) / (log_high - log_low) * RATE_BINS)
    half = F.floor(F.col("lstm_units_1") / 2)
    second = F.floor((F.col("lstm_units_2") - half) * RATE_BINS / (F.col("lstm_units_1") - half + 1))
    inside = lambda b: F.least(F.greatest(b, F.lit(0)), F.lit(RATE_BINS - 1)).cast("int")
    bins = {"lstm_units_1": steps("lstm_units_1", LSTM_UNITS_1), "lstm_units_2": inside(second), "dense_units": steps("dense_units", DENSE_UNITS),
            "dropout_rate": steps("dropout_rate", DROPOUT_RATE), "learning_rate": inside(rate), "epochs": steps("epochs", EPOCHS),
            "batch_size": steps("batch_size", BATCH_SIZE)}
    rows = F.array(*[F.struct(F.lit(name).alias("param"), b.alias("bin")) for name, b in bins.items()])
    return trials.select(*keep, F.explode(rows).alias("_b")).select(*keep, "_b.*")


def propose_trials(finished: DataFrame, candidates: DataFrame, best: int, share: float = 0.25, value: str = "value",
                   number: str = "number") -> DataFrame:
    """The ``best`` of the candidates ``(number, parameters)`` by density ratio: ``(number, score)``.

    The best ``share`` of the finished trials (highest value, then lowest number) are set against the others. A parameter's
    density in each group is the smoothed count of trials by bin plus one trial spread over all bins; the score adds the logs of the
    ratios. The trials are read once, into a table of parameters times bins; a whole batch of candidates is then looked up in it.
    Without finished trials all scores are 0. Parameters that are null count nowhere.
    """
    placed = with_position(finished.select(number, value, *PARAMETERS), F.desc(value), number, name="_place")
    n = placed.count()
    n_good = math.ceil(n * share)
    counts = parameter_bins(placed.withColumn("good", F.col("_place") < n_good), "good").groupBy("param", "bin", "good").agg(
        F.count(F.lit(1)).alias("n"))
    around = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in SMOOTHING.items()])
    spread = counts.select("param", "bin", "good", "n", F.explode(around).alias("s")).groupBy(
        "param", (F.col("bin") + F.col("s.d")).alias("bin")).agg(
        F.sum(F.when(F.col("good"), F.col("n") * F.col("s.w")).otherwise(0)).alias("_good"),
        F.sum(F.when(F.col("good"), 0).otherwise(F.col("n") * F.col("s.w"))).alias("_other"))

    def density(ninths: str, trials: int) -> Column:
        return (F.coalesce(ninths, F.lit(0)) / 9.0 + 1.0 / RATE_BINS) / (trials + 1.0)

    # at most parameters times bins rows
    looked_up = parameter_bins(candidates, number).filter("bin is not null").join(F.broadcast(spread), ["param", "bin"], "left")
    ratio = F.log(density("_good", n_good) / density("_other", n - n_good))
    scored = looked_up.groupBy(number).agg(F.round(F.sum(ratio), 6).alias("score"))
    return scored.orderBy(F.desc("score"), number).limit(best)


def complete_trials(log: DataFrame, state: str = "state") -> DataFrame:
    return log.filter(F.col(state) == COMPLETE)


def best_trial(log: DataFrame, value: str = "value", number: str = "number") -> DataFrame:
    """Completed trial of highest value; the earliest wins a tie."""
    return complete_trials(log).orderBy(F.desc(value), F.asc(number)).limit(1)


def optimization_history(log: DataFrame, number: str = "number", value: str = "value") -> DataFrame:
    """Value and best value so far, by trial number."""
    return prefix_scan(log.select(number, value), [number], maxima={"best_so_far": value})


def trial_states(log: DataFrame, state: str = "state") -> DataFrame:
    return log.groupBy(state).agg(F.count(F.lit(1)).alias("n_trials"))


def best_params_json(best: DataFrame) -> DataFrame:
    """Parameters of the best trial as one JSON object, the rate with all its digits."""
    return best.select(F.to_json(F.struct(*PARAMETERS)).alias("value"))
