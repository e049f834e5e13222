"""Dataset shaping: union, stratified folds, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.operators.scale import lookup_join, with_position
from presswork.session import materialise


def union_parts(parts: list[DataFrame], key: str) -> DataFrame:
    """Stack frames (duplicates kept) and renumber: part by part, by key inside each part."""
    stacked = None
    for number, part in enumerate(parts):
        tagged = part.withColumn("_part_no", F.lit(number))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return with_position(stacked, "_part_no", key, name="row_ix").drop("_part_no")


def _quota_bounds(size: Column, offset: Column, folds: int) -> Column:
    """Cumulative in-class row counts at the end of each fold.

    Labels are dealt to folds in turn over the class-sorted rows, so fold ``i`` gets as many rows
    of a class as there are numbers congruent to ``i`` in ``[offset, offset + size)``.
    """
    def quota(i: int) -> Column:
        return F.floor((offset + size - 1 - i) / folds) - F.floor((offset - 1 - i) / folds)

    bounds, total = [], F.lit(0).cast("long")
    for i in range(folds):
        total = total + quota(i)
        bounds.append(total)
    return F.array(*bounds)


def fold_ends(df: DataFrame, label: str, order: str, folds: int = 5) -> DataFrame:
    """``(label, _ends)``: per class, the ``order`` value of the last row of every fold.

    A fold takes consecutive rows of a class, so these few values are all that is needed to place
    any row. Finding them sorts ``(label, order)`` pairs only. A null end marks a fold before which
    the class has no row.
    """
    ranked = with_position(df.select(label, order), label, order, name="_pos")
    appearance = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    classes = (
        ranked.groupBy(label)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"), F.min("_pos").alias("_start"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(appearance), F.lit(0)))
        .select(label, "_start", _quota_bounds(F.col("_n"), F.col("_offset"), folds).alias("_bounds"))
    )
    placed = lookup_join(ranked, classes, [label], spread=[order], how="inner")
    taken = F.col("_pos") - F.col("_start") + 1
    last_rows = placed.filter(F.array_contains("_bounds", taken)).groupBy(label, "_bounds").agg(
        F.collect_list(F.struct(taken.alias("taken"), F.col(order).alias("at"))).alias("_last"))
    ends = F.transform("_bounds", lambda b: F.get(F.filter("_last", lambda s: s["taken"] == b), F.lit(0))["at"])
    return materialise(last_rows.select(label, ends.alias("_ends")), "fold-ends")


def stratified_kfold(df: DataFrame, label: str, order: str, folds: int = 5, name: str = "kfold") -> DataFrame:
    """Stratified folds without shuffling; classes ranked by first appearance in ``order``.

    ``order`` must be unique. Whatever else ``df`` holds (texts, vectors) is not moved: each row
    compares its ``order`` value with the fold ends of its class. A row without a label gets no fold.
    """
    ends = fold_ends(df, label, order, folds)
    joined = lookup_join(df, ends, [label], spread=[order])
    fold = F.size(F.filter("_ends", lambda end: end.isNull() | (end < F.col(order)))).cast("int")
    return joined.withColumn(name, F.when(F.col("_ends").isNotNull(), fold)).drop("_ends")


def fold_split(df: DataFrame, fold: int, name: str = "kfold") -> tuple[DataFrame, DataFrame]:
    """Training rows (all other folds) and validation rows of one fold."""
    return df.filter(F.col(name) != fold), df.filter(F.col(name) == fold)


def fold_counts(df: DataFrame, label: str, name: str = "kfold") -> DataFrame:
    """Training and validation rows per fold and class, for all folds in one pass."""
    sizes = df.groupBy(label, name).agg(F.count(F.lit(1)).alias("n_valid"))
    total = F.sum("n_valid").over(Window.partitionBy(label))
    return sizes.select(name, label, (total - F.col("n_valid")).alias("n_train"), "n_valid")


def assign_batches(df: DataFrame, key: str, batch_size: int = 16, seed: int = 0) -> DataFrame:
    """Pseudo-random order from a seeded hash of the key, cut into batches."""
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"))
    placed = with_position(df.withColumn("_shuffle", shuffled), "_shuffle", key, name="position")
    return placed.withColumn("batch", F.floor(F.col("position") / batch_size)).drop("_shuffle")
