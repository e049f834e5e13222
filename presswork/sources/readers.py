"""Readers. No schema inference: a file is read once."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.operators.features import sparse_schema
from presswork.sources.schemas import RAW_ARTICLE


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, bad: str | None = None) -> DataFrame:
    """JSON lines; ``bad`` names a column for the text of lines that do not parse (null for the others)."""
    if bad is None:
        return spark.read.schema(schema).json(path)
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    return spark.read.schema(wide).option("columnNameOfCorruptRecord", bad).json(path)


RECORD_START = "\n{"


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts ``(value)`` of the records in large files, each record on one line or on many.

    The opening brace of a record, and no other, stands at the beginning of a line, as writers of indented JSON leave it; a JSON
    string holds no raw line end, so text in quotes cannot look like one. Files are cut into byte ranges and each
    task looks for its own first record, so one large file is read by many tasks. A record without an end
    stops where the next one begins. The brackets and commas of a JSON array around the records are left out; other text
    before the first record comes with a brace before it, and is no record.
    """
    pieces = spark.read.option("lineSep", RECORD_START).text(path)
    # the first piece of a file has its brace still, or is what stands before the first record
    body = F.regexp_replace("value", r"\A[\s\x{FEFF}\[]++", "")
    whole = F.when(F.startswith(body, F.lit("{")), body).otherwise(F.concat(F.lit("{"), F.col("value")))
    text = F.when(body == "", body).otherwise(F.regexp_replace(whole, r"(?<=\})\s*+,?\s*+\]?\s*+\z", ""))
    return pieces.select(text.alias("value")).filter(F.col("value") != "")


def parse_articles(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Raw article records next to their source text: ``(value, a)``, ``a`` null where there is no record.

    ``layout`` says where records stand: "lines" (one per line), "records" (each on as many lines as it likes, see
    ``record_texts``) or "files" (one in each file). ``publish`` may be ``ISODate("...")``, an object with
    ``$date``, or a plain timestamp.
    """
    lines = record_texts(spark, path) if layout == "records" else spark.read.text(path, wholetext=layout == "files")
    parsed = lines.select("value", F.from_json(F.regexp_replace("value", r'ISODate\("([^"]*)"\)', '"$1"'), RAW_ARTICLE).alias("a"))
    stamp = F.coalesce(F.get_json_object("a.publish", "$['$date']"), F.col("a.publish"))
    dated = F.col("a").withField("publish", F.try_to_timestamp(stamp))
    return parsed.select("value", F.when(F.col("a.id").isNotNull(), dated).alias("a"))


def read_articles(spark: SparkSession, path: str, layout: str = "lines") -> tuple[DataFrame, DataFrame]:
    """The articles, and the texts ``(value)`` that are no record, for a table of rejects."""
    parsed = parse_articles(spark, path, layout)
    blank = F.trim("value") == ""
    return (parsed.filter(F.col("a").isNotNull()).select("a.*"),
            parsed.filter(F.col("a").isNull() & ~blank).select("value"))


def read_config(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON object, on one line or several, as a one-row table."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_features(spark: SparkSession, path: str, *splits: str) -> DataFrame:
    """Feature store, optionally only some splits (partition pruning, other files are not listed).

    Sparse vectors come as the structs they are stored as, see ``features.sparse_schema``.
    """
    stored = spark.read.parquet(path).schema
    vectors = [f.name for f in stored.fields if isinstance(f.dataType, VectorUDT)]
    store = spark.read.schema(sparse_schema(stored, *vectors)).parquet(path)
    return store.filter(F.col("split").isin(*splits)) if splits else store


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_fold_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
