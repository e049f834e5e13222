"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
INPUT_PARTITIONS = "spark.presswork.inputPartitions"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of texts as its files are split. Only where the deployer sets ``INPUT_PARTITIONS``, for
    files with a few large row groups that cannot be split, rows are dealt over so many tasks."""
    df = table(spark, sf_dir, name)
    n = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n), key) if n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
