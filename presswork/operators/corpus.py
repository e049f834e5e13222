"""Corpus assembly: content, categories, balanced subset and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.labels import CATEGORIES
from presswork.functions.text import clean_html, fold_accents, stable_hash

SPLITS = ("train", "test", "validation")


def content(title: Column, sapo: Column, body: Column, keywords: Column) -> Column:
    """Title, lead, body and keywords joined by blanks; missing parts are skipped."""
    return F.concat_ws(" ", title, sapo, body, keywords)


def category_of(cates: Column) -> Column:
    """First category name without accents; null for an empty list."""
    return fold_accents(F.get(cates, F.lit(0)))


def assemble_articles(raw: DataFrame) -> DataFrame:
    """Raw article records to ``(id, content, category)`` with the HTML body cleaned."""
    return raw.select(
        "id",
        content(F.col("title"), F.col("sapo"), clean_html(F.col("body")), F.col("keywords")).alias("content"),
        category_of(F.col("cates")).alias("category"),
    )


def balanced_subset(df: DataFrame, label: str, key: str, per_class: int,
                    classes: Sequence[str] = CATEGORIES) -> DataFrame:
    """Keep the listed classes and, in each, exactly the ``per_class`` rows of smallest md5(key).

    A histogram over hash buckets finds the bucket where each class reaches its number. Rows
    past it are dropped before any shuffle, and ranking runs per (class, bucket), so a
    class holding a third of the corpus is never one group.
    """
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    known = df.filter(F.col(label).isin(*classes)).withColumn("_digest", digest)
    hashed = known.withColumn("_bucket", F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int"))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(label, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        .filter(F.col("_start") < per_class)
    )
    # at most len(classes) * HASH_BUCKETS rows
    candidates = hashed.join(F.broadcast(starts), [label, "_bucket"])
    inside = Window.partitionBy(label, "_bucket").orderBy("_digest", key)
    return (
        candidates.withColumn("_rank", F.row_number().over(inside) + F.col("_start"))
        .filter(F.col("_rank") <= per_class)
        .drop("_digest", "_bucket", "_start", "_rank")
    )


def split_of(key: Column, train: int = 70, test: int = 15) -> Column:
    """Split name from a hash of the key: stable under repartitioning and reruns."""
    bucket = stable_hash(key) % 100
    return F.when(bucket < train, SPLITS[0]).when(bucket < train + test, SPLITS[1]).otherwise(SPLITS[2])


def split_summary(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split and a total row."""
    return (
        df.rollup(split).agg(F.count(F.lit(1)).alias("n_rows"), F.grouping(split).alias("_total"))
        .select(F.when(F.col("_total") == 1, "total").otherwise(F.col(split)).alias("dataset"), "n_rows")
    )
