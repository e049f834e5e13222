"""Multinomial naive Bayes over word counts, as aggregates and lookup joins."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.scores import mean_of_models
from presswork.operators.scale import BROADCAST_BYTES, BROADCAST_ROWS, count_cut, fits_broadcast, lookup_join
from presswork.session import materialise

TOKEN_BYTES = 32  # allowed for a word beside its weights


@dataclass
class BayesModel:
    """``table``: one row per word ``(token, theta, n)``, theta an array over ``classes``.

    ``fits`` is the outcome of measuring the table once, for all scoring with this model.
    """

    classes: tuple
    table: DataFrame
    priors: list[float]
    fits: bool | None = None

    def save(self, path: str, mode: str = "error") -> None:
        """Words and classes as two Parquet tables below ``path``."""
        self.table.write.mode(mode).parquet(f"{path}/words")
        rows = [(i, str(c), p) for i, (c, p) in enumerate(zip(self.classes, self.priors))]
        classes = self.table.sparkSession.createDataFrame(rows, "class_ix int, label string, prior double")
        classes.write.mode(mode).parquet(f"{path}/classes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BayesModel:
        rows = spark.read.parquet(f"{path}/classes").orderBy("class_ix").collect()
        table = spark.read.parquet(f"{path}/words")
        return BayesModel(tuple(r["label"] for r in rows), table, [r["prior"] for r in rows], fits_broadcast(table))


def _cell_counts(df: DataFrame, words: str, cell: Column, names: Sequence[str]) -> DataFrame:
    """``(token, names...)``: occurrences of a word in the rows of each cell, numbered in the order of ``names``.

    One number per word and cell is counted map-side, so a frequent word costs one row per cell and task; the few cells of a
    word become columns after that.
    """
    tokens = df.select(cell.alias("_cell"), F.explode_outer(words).alias("token")).filter(F.col("token").isNotNull())
    counted = tokens.groupBy("token", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy("token").agg(*[
        F.coalesce(F.sum(F.when(F.col("_cell") == i, F.col("_n"))), F.lit(0)).alias(name) for i, name in enumerate(names)])


def _class_code(label: str, classes: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.col(label) == c, i) for i, c in enumerate(classes)])


def fit(df: DataFrame, label: str, words: str, classes: Sequence[str], smoothing: float = 1.0,
        min_count: int = 1) -> BayesModel:
    """Log likelihoods with additive smoothing and smoothed log priors.

    Words are counted per class map-side. The word table is stored, since scoring reads it again.
    """
    known = df.filter(F.col(label).isin(*classes))
    counted = _cell_counts(known, words, _class_code(label, classes), [f"n{i}" for i in range(len(classes))])
    counts = materialise(counted.filter(sum(F.col(f"n{i}") for i in range(len(classes))) >= min_count), "word-counts")
    totals = counts.agg(
        F.count(F.lit(1)).alias("v"),
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(classes))],
    ).first()
    docs = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_docs = sum(docs.values())
    priors = [
        math.log((docs.get(c, 0) + smoothing) / (n_docs + smoothing * len(classes))) for c in classes
    ]
    theta = [
        F.log((F.col(f"n{i}") + smoothing) / F.lit(totals[f"n{i}"] + smoothing * totals["v"]))
        for i in range(len(classes))
    ]
    n = sum(F.col(f"n{i}") for i in range(len(classes)))
    table = counts.select("token", F.array(*theta).alias("theta"), n.alias("n"))
    return BayesModel(tuple(classes), table, priors, fits_broadcast(table))


def _head_columns(words: str, head: DataFrame, cells: int) -> tuple[Column, Column]:
    """The summed weights of a row's words in ``head``, and the row's other words."""
    listed = head.select("token", "weights").toArrow().combine_chunks()  # of checked size
    weights = pc.list_flatten(listed.column("weights")).to_numpy().reshape(-1, cells)
    # one line of weights per cell, with zero at the end for words that are not listed
    lines = np.ascontiguousarray(np.vstack([weights, np.zeros((1, cells))]).T)
    context = head.sparkSession.sparkContext
    names, shared_lines = context.broadcast(listed.select(["token"])), context.broadcast(lines)

    @F.arrow_udf("array<double>")
    def summed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = pa.concat_arrays(names.value.column(0).chunks or [pa.array([], pa.string())])
        for texts in batches:
            at = pc.index_in(texts.flatten().cast(tokens.type), value_set=tokens).fill_null(len(tokens)).to_numpy()
            sizes = texts.value_lengths().fill_null(0).to_numpy()
            filled = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[filled]
            sums = np.zeros((len(texts), cells))
            if filled.size:
                for cell, line in enumerate(shared_lines.value):
                    sums[filled, cell] = np.add.reduceat(line[at], starts)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * cells, pa.int32()), pa.array(sums.ravel()))

    @F.arrow_udf("array<string>")
    def beyond(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = pa.concat_arrays(names.value.column(0).chunks or [pa.array([], pa.string())])
        for texts in batches:
            flat = texts.flatten().cast(tokens.type)
            rare = pc.index_in(flat, value_set=tokens).is_null()
            ends = np.concatenate([[0], np.cumsum(texts.value_lengths().fill_null(0).to_numpy())])
            upto = np.concatenate([[0], np.cumsum(rare.to_numpy(zero_copy_only=False))])
            yield pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), flat.filter(rare).cast(pa.string()))

    return summed(F.col(words)), beyond(F.col(words))


def _summed_weights(df: DataFrame, key: list[str], words: str, weighted: DataFrame, cells: int, fits: bool) -> DataFrame:
    """``(key, s0, s1, ...)``: the weights of a key's words, from ``weighted`` with ``(token, weights, n)``, added up by cell.

    The most frequent words go to where the rows are and are summed inside them; beside a table of checked size that is all. Of
    a larger one a row's other words, few of all, are joined to the rest.
    """
    cut = 0 if fits else count_cut(weighted, "n", _head_rows(cells))
    in_head = F.col("n") >= cut if cut is not None else F.lit(False)
    summed, beyond = _head_columns(words, weighted.filter(in_head), cells)
    parts = df.select(*key, summed.alias("weights"))
    if not fits:
        tail = weighted.filter(~in_head).select("token", "weights")
        rare = df.select(*key, F.explode_outer(beyond).alias("token")).filter(F.col("token").isNotNull())
        parts = parts.unionByName(rare.join(tail.hint("merge"), "token").select(*key, "weights"))
    return parts.groupBy(*key).agg(*[F.sum(F.get("weights", F.lit(i))).alias(f"s{i}") for i in range(cells)])


def _head_rows(cells: int) -> int:
    return min(BROADCAST_ROWS, BROADCAST_BYTES // (8 * cells + TOKEN_BYTES))


def score(df: DataFrame, key: list[str], words: str, model: BayesModel) -> DataFrame:
    """``(key, logits)``; words outside the model count for nothing.

    The words of a document meet the model where they are and are summed there: only one partial sum per document and task
    is shuffled. Beside a model too large for that, so it is done with its most frequent words.
    """
    classes = len(model.classes)
    if fits_broadcast(model.table) if model.fits is None else model.fits:
        tokens = df.select(*key, F.explode_outer(words).alias("token"))
        scored = lookup_join(tokens, model.table, ["token"], spread=key, weight="n", fits=True)
        summed = scored.groupBy(*key).agg(*[F.sum(F.get("theta", F.lit(i))).alias(f"s{i}") for i in range(classes)])
    else:
        weighted = model.table.select("token", F.col("theta").alias("weights"), "n")
        summed = _summed_weights(df, key, words, weighted, classes, False)
    logits = [F.coalesce(f"s{i}", F.lit(0.0)) + F.lit(prior) for i, prior in enumerate(model.priors)]
    return summed.select(*key, F.array(*logits).alias("logits"))


@dataclass
class FoldedBayesModel:
    """One model per fold from one count: ``table`` has ``(token, theta, n)``, theta an array (folds) of arrays (classes).

    A word that a fold's training rows lack has zeros there, so it counts for nothing.
    """

    classes: tuple
    table: DataFrame
    priors: list[list[float]]
    fits: bool | None = None


def fit_kfold(df: DataFrame, label: str, words: str, classes: Sequence[str], fold: str = "kfold", folds: int = 5,
              smoothing: float = 1.0) -> FoldedBayesModel:
    """The model of a fold learns from all other folds: counts are total less held-out counts, in one pass over the text."""
    known = df.filter(F.col(label).isin(*classes) & F.col(fold).between(0, folds - 1))
    cells = [(f, i) for f in range(folds) for i in range(len(classes))]
    held = _cell_counts(known, words, F.col(fold) * len(classes) + _class_code(label, classes), [f"h{f}_{i}" for f, i in cells])
    totals = {i: sum(F.col(f"h{f}_{i}") for f in range(folds)) for i in range(len(classes))}
    rest = held.select("token", *[(totals[i] - F.col(f"h{f}_{i}")).alias(f"n{f}_{i}") for f, i in cells])
    seen = {f: sum(F.col(f"n{f}_{i}") for i in range(len(classes))) for f in range(folds)}
    counts = materialise(rest.select("*", *[seen[f].alias(f"n{f}") for f in range(folds)]), "fold-counts")
    sums = counts.agg(*[F.coalesce(F.sum(f"n{f}_{i}"), F.lit(0)).alias(f"n{f}_{i}") for f, i in cells],
                      *[F.count_if(F.col(f"n{f}") > 0).alias(f"v{f}") for f in range(folds)],
                      F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("bytes")).first()
    docs = {(r[label], r[fold]): r["n"] for r in known.groupBy(label, fold).agg(F.count(F.lit(1)).alias("n")).collect()}
    priors = []
    for f in range(folds):
        own = [sum(n for (c, g), n in docs.items() if c == cls and g != f) for cls in classes]
        priors.append([math.log((n + smoothing) / (sum(own) + smoothing * len(classes))) for n in own])
    masses = F.array(*[F.array(*[F.lit(sums[f"n{f}_{i}"] + smoothing * sums[f"v{f}"]) for i in range(len(classes))]) for f in range(folds)])
    per_fold = F.array(*[F.struct(F.col(f"n{f}").alias("seen"), F.array(*[F.col(f"n{f}_{i}") for i in range(len(classes))]).alias("n"))
                         for f in range(folds)])
    # lambdas over arrays: written out, so many cells make a method that Java does not compile
    theta = F.zip_with(per_fold, masses, lambda own, mass: F.zip_with(
        own["n"], mass, lambda n, m: F.when(own["seen"] > 0, F.log((n + smoothing) / m)).otherwise(0.0)))
    table = counts.select("token", theta.alias("theta"), sum(F.col(f"n{f}") for f in range(folds)).alias("n"))
    fits = sums["rows"] <= _head_rows(len(cells)) and sums["bytes"] + 8 * len(cells) * sums["rows"] <= BROADCAST_BYTES
    return FoldedBayesModel(tuple(classes), table, priors, fits)


def score_kfold(df: DataFrame, key: list[str], words: str, model: FoldedBayesModel) -> DataFrame:
    """``(key, model_logits, logits)``: logits of every fold's model, and their mean over the models."""
    folds, classes = len(model.priors), len(model.classes)
    weighted = model.table.select("token", F.flatten("theta").alias("weights"), "n")
    summed = _summed_weights(df, key, words, weighted, folds * classes, bool(model.fits))
    logits = F.array(*[
        F.array(*[F.coalesce(f"s{f * classes + i}", F.lit(0.0)) + F.lit(model.priors[f][i]) for i in range(classes)]) for f in range(folds)])
    return summed.select(*key, logits.alias("model_logits")).withColumn("logits", mean_of_models(F.col("model_logits")))
