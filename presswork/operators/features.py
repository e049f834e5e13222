"""Text and vector features."""

from __future__ import annotations

from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions.text import stable_hash
from presswork.session import materialise, scratch_path


def _hex_digits(buckets: int) -> int | None:
    """``k`` when ``buckets`` is ``16 ** k`` (at most 8 digits), else None."""
    return next((k for k in range(1, 9) if 16**k == buckets), None)


def bucket_names(buckets: int) -> list[str]:
    digits = _hex_digits(buckets)
    return [f"{i:0{digits}x}" if digits else str(i) for i in range(buckets)]


def word_buckets(words: Column, buckets: int) -> Column:
    """Name of the hash bucket ``stable_hash(word) % buckets`` of every word.

    For a power of 16 the remainder is simply the last of the hash's hex digits.
    """
    digits = _hex_digits(buckets)
    if digits:
        return F.transform(words, lambda w: F.substring(F.md5(w.cast("binary")), 9 - digits, digits))
    return F.transform(words, lambda w: (stable_hash(w) % buckets).cast("string"))


def hashed_counts(df: DataFrame, words: str, buckets: int, out: str = "tf") -> DataFrame:
    """Sparse vector of bucket counts. A narrow step: counting stays inside each row."""
    counter = CountVectorizerModel.from_vocabulary(bucket_names(buckets), "_buckets", out)
    return counter.transform(df.withColumn("_buckets", word_buckets(F.col(words), buckets))).drop("_buckets")


def tfidf(df: DataFrame, words: str, buckets: int, out: str = "features") -> DataFrame:
    """Hashed tf-idf with ``idf = ln((N + 1) / (df + 1))``; the word lists are not kept.

    The sparse counts are stored once; fitting (one tree aggregate of ``buckets`` numbers) and scoring
    start from there, so texts are tokenised once.
    """
    counts = materialise(hashed_counts(df, words, buckets, "_tf").drop(words), "bucket-counts")
    return IDF(inputCol="_tf", outputCol=out).fit(counts).transform(counts).drop("_tf")


def ml_tfidf(df: DataFrame, words: str, buckets: int, out: str = "features", keep_counts: str | None = None) -> DataFrame:
    """Same shape with Spark ML's own hash; ``keep_counts`` names a column for the counts."""
    name = keep_counts or "_tf"
    counts = materialise(HashingTF(numFeatures=buckets, inputCol=words, outputCol=name).transform(df).drop(words), "bucket-counts")
    scored = IDF(inputCol=name, outputCol=out).fit(counts).transform(counts)
    return scored if keep_counts else scored.drop(name)


# How a vector is stored.
SPARSE = T.StructType([
    T.StructField("type", T.ByteType()), T.StructField("size", T.IntegerType()),
    T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType())),
])


def sparse_schema(schema: T.StructType, *vectors: str) -> T.StructType:
    """``schema`` with vector columns as the structs they are stored as."""
    return T.StructType([T.StructField(f.name, SPARSE) if f.name in vectors else f for f in schema.fields])


def store_sparse(df: DataFrame, *vectors: str) -> DataFrame:
    """A stored copy with sparse vectors as ``(size, indices, values)``: nothing is made dense."""
    path = scratch_path(df.sparkSession, "sparse")
    df.write.parquet(path)
    return df.sparkSession.read.schema(sparse_schema(df.schema, *vectors)).parquet(path)


def nonzero(stored: DataFrame, key: str, vector: str, value: str) -> DataFrame:
    """Long form ``(key, bucket, value)`` of the non-zero entries of stored sparse vectors."""
    entries = F.arrays_zip(F.col(f"{vector}.indices").alias("bucket"), F.col(f"{vector}.values").alias(value))
    return stored.select(key, F.inline(entries)).toDF(key, "bucket", value).filter(F.col(value) != 0)


def feature_shapes(df: DataFrame, split: str, features: str) -> DataFrame:
    """Rows and vector length per split; equal min and max mean a rectangular matrix."""
    size = F.size(features)
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))
