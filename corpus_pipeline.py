"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage works on all that the one before kept. The first four return the columns of documents; the
last returns one row per packed piece. Stage tables are written as Parquet to the folder that the
session names in ``spark.checkpoint.dir``, so a lost executor costs no finished stage.

Empty tables run through to an empty result. Null and empty texts are documents like any other: the
classifier scores them, near-duplicate search sees them as equal, and packing gives the one that
stays a sequence place for its end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswork.llm import decontaminate, packing, quality, secret_scan, simhash
from presswork.session import discard, materialise

ORACLE_SQL = None  # no stage is expressible in SQL; the stages are tested against brute force


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from all labelled documents it is given; where these are not of
    both classes it can judge nothing and all documents stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    # the statistics are made twice rather than joined back, so that texts are not shuffled
    model = quality.fit(quality.labelled(quality.with_statistics(docs.select("doc_id", "text"), drop_text=True), labels))
    return quality.accepted(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id: shingles of four words,
    fingerprints that differ in four bits at most."""
    return simhash.keep_one(docs, words=simhash.WORDS, radius=simhash.RADIUS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_documents(docs, benchmark)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; every document stays."""
    return secret_scan.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents are encoded and packed into sequences: one row per piece, with its place and its ids."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_duplicates", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        docs = materialise(stage(spark, before, sf_dir), f"stage-{name}")
        discard(before)
    return docs
