import pytest
from pyspark.sql import functions as F

from presswork.functions import labels as lab
from presswork.functions import scores
from presswork.operators import scoring, words


def rows(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def test_encode_and_decode_all_categories(spark):
    names = [*lab.CATEGORIES, "Unknown", None]
    df = spark.createDataFrame(list(enumerate(names)), "id long, label string")
    coded = df.withColumn("code", lab.label_encode(F.col("label")))
    assert rows(coded, "code") == [*range(13), -1, -1]
    decoded = coded.withColumn("back", lab.label_decode(F.col("code")))
    assert rows(decoded, "back") == [*lab.CATEGORIES, None, None]
    with pytest.raises(Exception, match="unknown label code -1"):
        coded.select(lab.label_decode(F.col("code"), strict=True)).collect()


def test_one_hot_columns_do_not_depend_on_the_split(spark):
    df = spark.createDataFrame([(0, "b"), (1, "zz"), (2, None)], "id long, label string")
    assert rows(df.select("id", lab.one_hot(F.col("label"), ["c", "b", "a"]).alias("y")), "y") == [
        [0, 1, 0], [0, 0, 0], [0, 0, 0]]


def test_first_max_takes_the_lowest_class_on_a_tie(spark):
    df = spark.createDataFrame([(0, [0.5, 1.0, 1.0]), (1, []), (2, None)], "id long, v array<double>")
    assert rows(df.select("id", lab.first_max(F.col("v")).alias("m")), "m") == [1, None, None]


@pytest.mark.parametrize("n", [0, 5, 6, 7, 20])
def test_lengths(spark, n):
    ids = list(range(10, 10 + n))
    df = spark.createDataFrame([(0, ids)], "id long, ids array<int>")
    fixed, cut = df.select(
        lab.fixed_length_ids(F.col("ids"), 8).alias("f"), lab.hard_cut_ids(F.col("ids"), 8).alias("c")).first()
    framed = [0, *ids[:6], 2]
    assert fixed == framed + [1] * (8 - len(framed))
    framed = [0, *ids, 2][:8]
    assert cut == framed + [1] * (8 - len(framed))


def test_mask_goes_by_value(spark):
    df = spark.createDataFrame([(0, [0, 5, 1, 7, 2, 1])], "id long, ids array<int>")
    assert rows(df.select("id", lab.attention_mask(F.col("ids")).alias("m")), "m") == [[1, 1, 0, 1, 1, 0]]


def test_vocab_order_and_encoding(spark):
    docs = spark.createDataFrame(
        [(0, ["b", "a", "a", "c", "c"]), (1, []), (2, ["zzz", "b", "a"]), (3, None)], "id long, words array<string>")
    vocab = words.build_vocab(docs, "words", max_words=3)
    assert [(r["token"], r["n"], r["token_id"]) for r in vocab.orderBy("token_id").collect()] == [
        ("a", 3, 4), ("b", 2, 5), ("c", 2, 6)]
    encoded = words.encode_tokens(docs, "id", "words", vocab)
    assert rows(encoded, "ids") == [[5, 4, 4, 6, 6], [], [3, 5, 4], []]
    assert words.build_vocab(docs, "words", min_count=2).count() == 3


@pytest.mark.parametrize("listed", [["a", "b", "c"], []])
def test_both_ways_to_ids_agree(spark, listed):
    docs = spark.createDataFrame(
        [(i, None if i % 7 == 0 else [("a", "b", "q", None, "")[(i * k) % 5] for k in range(i % 6)]) for i in range(60)], "id long, words array<string>")
    vocab = spark.createDataFrame([(w, 9 - i, i + 4) for i, w in enumerate(listed)], "token string, n long, token_id int")
    near, far = ({r.id: r.ids for r in words.encode_tokens(docs, "id", "words", vocab, fits=f).collect()} for f in (True, False))
    assert near == far
    ids = dict(zip(listed, range(4, 9)))
    assert near == {r.id: [ids.get(w, 3) for w in r.words or []] for r in docs.collect()}


@pytest.mark.parametrize("max_words", [1, 2, 7, 40, 10_000])
def test_vocab_of_limited_size_is_a_prefix_of_the_full_one(spark, max_words):
    texts = [(i, [f"w{i * k % 97}" for k in range(i % 13)]) for i in range(200)]
    docs = spark.createDataFrame(texts, "id long, words array<string>")
    full = sorted((r["token_id"], r["token"], r["n"]) for r in words.build_vocab(docs, "words").collect())
    some = sorted((r["token_id"], r["token"], r["n"]) for r in words.build_vocab(docs, "words", max_words=max_words).collect())
    assert some == full[:max_words]
    assert [(-n, t) for _, t, n in full] == sorted((-n, t) for _, t, n in full)


def test_softmax_and_cross_entropy(spark):
    df = spark.createDataFrame([(0, [1000.0, 1000.0], 1), (1, [-2.0, 3.0], 0)], "id long, l array<double>, y int")
    p = rows(df.select("id", scores.softmax(F.col("l")).alias("p")), "p")
    assert p[0] == pytest.approx([0.5, 0.5]) and sum(p[1]) == pytest.approx(1.0)
    loss = rows(df.select("id", scores.cross_entropy(F.col("l"), F.col("y")).alias("x")), "x")
    assert loss == pytest.approx([0.6931471805599453, 5.006715348489118])


def test_confidence_shapes(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 0.0])], "id long, logits array<double>")
    wide = scoring.confidence_wide(df, ["id"], "logits", ["x", "y", "z"])
    long = scoring.confidence_long(wide, ["id"], ["x", "y", "z"])
    assert wide.columns == ["id", "x", "y", "z"]
    assert {r["Label"] for r in long.collect()} == {"x", "y", "z"}
    assert sum(r["Confidence"] for r in long.collect()) == pytest.approx(1.0)


def test_compare_predictions(spark):
    long = spark.createDataFrame(
        [(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (2, "b", "y")], "id long, model string, label string")
    got = {r["id"]: (r["a"], r["b"], r["agree"]) for r in scoring.compare_predictions(long, "id", ["a", "b"]).collect()}
    assert got == {1: ("x", "x", True), 2: ("x", "y", False)}
