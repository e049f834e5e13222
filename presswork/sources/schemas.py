"""Explicit schemas of every file the jobs read."""

from __future__ import annotations

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())

RAW_ARTICLE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("sapo", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("publish", T.StringType()),
    T.StructField("tags", _strings),
    T.StructField("keywords", _strings),
    T.StructField("cates", _strings),
])

CLEAN_ARTICLE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("content", T.StringType()),
    T.StructField("category", T.StringType()),
])

PROCESSED_ARTICLE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("processed_content", T.StringType()),
    T.StructField("category", T.StringType()),
])

REPORT = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("support", T.DoubleType()),
])

TRIAL_LOG = T.StructType([
    T.StructField("number", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("dense_units", T.IntegerType()),
    T.StructField("dropout_rate", T.DoubleType()),
    T.StructField("epochs", T.IntegerType()),
    T.StructField("learning_rate", T.DoubleType()),
    T.StructField("lstm_units_1", T.IntegerType()),
    T.StructField("lstm_units_2", T.IntegerType()),
    T.StructField("state", T.StringType()),
])

BEST_PARAMETERS = T.StructType([
    T.StructField("lstm_units_1", T.IntegerType()),
    T.StructField("lstm_units_2", T.IntegerType()),
    T.StructField("dense_units", T.IntegerType()),
    T.StructField("dropout_rate", T.DoubleType()),
    T.StructField("learning_rate", T.DoubleType()),
    T.StructField("epochs", T.IntegerType()),
    T.StructField("batch_size", T.IntegerType()),
])
