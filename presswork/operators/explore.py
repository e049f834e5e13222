"""Looking at a dataset: distributions, lengths, previews, column info."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_distribution(df: DataFrame, split: str, category: str) -> DataFrame:
    return df.groupBy(split, category).agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_categories(df: DataFrame, category: str, key: str) -> DataFrame:
    """Categories with the key of their first row, in order of first appearance."""
    return df.groupBy(category).agg(F.min(key).alias("first_seen")).orderBy("first_seen")


def length_histogram(df: DataFrame, length: str, width: int) -> DataFrame:
    start = (F.floor(F.col(length) / width) * width).alias("from_tokens")
    return df.groupBy(start).agg(F.count(F.lit(1)).alias("n_texts"))


def length_stats(df: DataFrame, length: str, limits: Sequence[int]) -> DataFrame:
    """Count, maximum, mean, median, 95th percentile and share above each limit.

    The lengths are counted first, so the exact percentiles weigh distinct lengths only.
    """
    by_length = df.groupBy(length).agg(F.count(F.lit(1)).alias("_n"))
    n, total = F.sum("_n"), F.sum(F.col(length) * F.col("_n"))
    over = [
        F.round(F.sum(F.when(F.col(length) > limit, F.col("_n")).otherwise(0)) / n, 6).alias(f"share_over_{limit}")
        for limit in limits
    ]
    return by_length.agg(
        n.alias("n_texts"),
        F.max(length).cast("long").alias("max_tokens"),
        F.round(total / n, 6).alias("mean_tokens"),
        F.percentile(length, F.lit(0.5), F.col("_n")).alias("median_tokens"),
        F.round(F.percentile(length, F.lit(0.95), F.col("_n")), 6).alias("p95_tokens"),
        *over,
    )


def preview(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    return df.orderBy(key).limit(n)


def sample_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """``n`` rows picked by hash: the same rows in every run."""
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    return df.orderBy(digest, key).limit(n)


def table_info(df: DataFrame) -> DataFrame:
    """Column name, non-null count and type, from one aggregate over the table."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = counts.unpivot([], df.columns, "column_name", "non_null")
    types = reduce(lambda acc, t: acc.when(F.col("column_name") == t[0], t[1]), df.dtypes, F)
    return rows.withColumn("dtype", types)
