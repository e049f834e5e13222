"""Repeated ids with unlike texts."""

from presswork.llm import simhash


def test_keep_one_judges_each_text_of_a_key(spark):
    text = {n: " ".join(f"{n}{i}" for i in range(30)) for n in "abc"}
    rows = [(1, text["a"]), (5, text["a"]), (5, text["b"]), (6, text["b"]), (7, text["c"]), (7, text["c"])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, text["a"]), (5, text["b"]), (7, text["c"])]
