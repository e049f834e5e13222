"""Plans that must hold at scale: what is read, and which steps stay without a shuffle."""

import pytest
from pyspark.sql import functions as F

from presswork.operators import bayes, features, linear, words
from presswork.functions.text import kept_words
from presswork.plans import QUERIES


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_preprocessing_is_narrow_and_reads_two_columns(docs):
    text = plan(words.preprocess(docs, "doc_id", "text"))
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_hashed_counts_are_narrow(docs):
    kept = docs.select("doc_id", kept_words(F.col("text")).alias("words"))
    assert "Exchange" not in plan(features.hashed_counts(kept, "words", 16))


def test_vector_scoring_is_narrow(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    weights, bias = linear.model_arrays(linear.fit_centroids(emb, "label", "embedding"), "label", list(range(10)))
    text = plan(linear.score_vectors(emb, "embedding", weights, bias))
    assert "Exchange" not in text and text.split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1
    scored = linear.score_vectors(emb, "embedding", weights, bias)
    assert plan(linear.logits_long(scored, "vec_id")).split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1


def test_bayes_scoring_shuffles_partial_sums_only(docs):
    kept = docs.select("doc_id", "lang", kept_words(F.col("text")).alias("words"))
    model = bayes.fit(kept, "lang", "words", ["de", "en", "es", "fr"])
    physical = plan(bayes.score(kept, ["doc_id"], "words", model)).split("== Physical Plan ==")[1]
    assert physical.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in physical
    assert physical.index("Exchange hashpartitioning") < physical.index("partial_sum")


def test_words_are_computed_once_per_row(docs):
    kept = docs.select(kept_words(F.col("text")).alias("words"))
    counted = words.word_counts(kept, "words")
    assert plan(counted).split("== Physical Plan ==")[1].count("regexp_replace") <= 2


@pytest.mark.parametrize("name", ["strip_chars", "split_sentences", "tokenize_words", "preprocess_text", "preprocess_quality",
                                  "clean_html", "scrub_links_emails_numbers", "fold_category", "assemble_content"])
def test_registered_text_queries_move_no_text(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_compound_words_are_merged_in_their_rows(spark):
    physical = plan(QUERIES["apply_phrases"](spark, "/root/testdata/sf0.001")).split("== Physical Plan ==")[1]
    assert "Exchange" not in physical and "Window" not in physical and "Generate" not in physical


def test_known_words_become_ids_in_their_rows(docs, spark):
    kept = docs.select("doc_id", kept_words(F.col("text")).alias("words"))
    vocab = spark.createDataFrame([("the", 9, 4)], "token string, n long, token_id int")
    assert "Exchange" not in plan(words.encode_tokens(kept, "doc_id", "words", vocab))


def test_ensemble_mean_is_narrow(spark):
    assert "Exchange" not in plan(QUERIES["ensemble_mean_logits"](spark, "/root/testdata/sf0.001"))
    assert "Exchange" not in plan(QUERIES["compare_predictions"](spark, "/root/testdata/sf0.001"))
