import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.functions.labels import label_encode
from presswork.operators import bayes, features, learners, linear, shaping

CLASSES = ["a", "b", "c"]
rng = np.random.default_rng(3)
X = rng.normal(size=(120, 6)).astype(np.float32)
Y = [CLASSES[i] for i in rng.integers(0, 3, 120)]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, Y[i], X[i].tolist()) for i in range(120)]
    return spark.createDataFrame(rows, "id long, label string, v array<float>").repartition(4).cache()


def centroid_logits(x, y, test):
    out = []
    for c in CLASSES:
        mu = x[[i for i, label in enumerate(y) if label == c]].astype(float).mean(0)
        out.append(test.astype(float) @ mu - (mu @ mu) / 2)
    return np.array(out).T


def test_centroid_scores(vectors):
    weights, bias = linear.model_arrays(linear.fit_centroids(vectors, "label", "v"), "label", CLASSES)
    got = linear.score_vectors(vectors, "v", weights, bias).orderBy("id").collect()
    assert np.allclose([r["logits"] for r in got], centroid_logits(X, Y, X))


def test_kfold_ensemble(vectors):
    folded = shaping.stratified_kfold(vectors, "label", "id")
    kfold = {r["id"]: r["kfold"] for r in folded.collect()}
    weights, bias = linear.model_arrays(linear.fit_kfold_centroids(folded, "label", "v"), "label", CLASSES, "fold")
    want = []
    for f in range(5):
        keep = [i for i in range(120) if kfold[i] != f]
        want.append(centroid_logits(X[keep], [Y[i] for i in keep], X))
    scored = linear.score_vectors(vectors, "v", weights, bias).cache()
    rows = scored.orderBy("id").collect()
    assert np.allclose(np.array([r["model_logits"] for r in rows]).transpose(1, 0, 2), want)
    assert np.allclose([r["logits"] for r in rows], np.mean(want, axis=0))
    long = linear.softmax_long(linear.ensemble_mean(linear.logits_long(scored, "id"), "id"), "id")
    total = long.groupBy("id").agg(F.sum("confidence").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in total)


def test_null_vectors_score_null(spark, vectors):
    weights, bias = linear.model_arrays(linear.fit_centroids(vectors, "label", "v"), "label", CLASSES)
    rows = spark.createDataFrame([(0, None), (1, [1.0] * 6), (2, None)], "id long, v array<double>").coalesce(1)
    got = {r["id"]: r["logits"] for r in linear.score_vectors(rows, "v", weights, bias).collect()}
    assert got[0] is None and got[2] is None and len(got[1]) == 3


def test_class_missing_from_a_model_never_wins(spark, vectors):
    model = linear.fit_centroids(vectors.filter("label <> 'c'"), "label", "v")
    weights, bias = linear.model_arrays(model, "label", CLASSES)
    scored = linear.score_vectors(vectors, "v", weights, bias)
    assert all(r["logits"][2] == -math.inf for r in scored.collect())


DOCS = [
    (0, "a", ["x", "x", "y"]), (1, "a", ["x", "z"]), (2, "b", ["y", "y", "w"]), (3, "b", []), (4, "c", ["q"]), (5, "zz", ["x"]),
]


def test_bayes_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "id long, label string, words array<string>")
    model = bayes.fit(docs, "label", "words", CLASSES)
    known = [d for d in DOCS if d[1] in CLASSES]
    vocab = sorted({w for d in known for w in d[2]})
    counts = {c: Counter(w for d in known if d[1] == c for w in d[2]) for c in CLASSES}
    prior = [math.log((sum(d[1] == c for d in known) + 1) / (len(known) + 3)) for c in CLASSES]
    theta = {
        w: [math.log((counts[c][w] + 1) / (sum(counts[c].values()) + len(vocab))) for c in CLASSES] for w in vocab
    }
    assert model.priors == pytest.approx(prior)
    assert {r["token"]: r["theta"] for r in model.table.collect()} == {w: pytest.approx(t) for w, t in theta.items()}
    new = spark.createDataFrame([(7, ["x", "never"]), (8, []), (9, None)], "id long, words array<string>")
    got = {r["id"]: r["logits"] for r in bayes.score(new, ["id"], "words", model).collect()}
    assert got[7] == pytest.approx([p + t for p, t in zip(prior, theta["x"])])
    assert got[8] == pytest.approx(prior) and got[9] == pytest.approx(prior)


def test_bayes_agrees_with_spark_ml(spark):
    docs = spark.createDataFrame(DOCS[:5], "id long, label string, words array<string>")
    docs = docs.withColumn("y", label_encode(F.col("label"), CLASSES).cast("double"))
    counts = features.hashed_counts(docs, "words", 4096, "features")
    ml = {r["id"]: r["rawPrediction"].toArray() for r in learners.text_bayes(counts, "y").transform(counts).collect()}
    ours = {r["id"]: r["logits"] for r in bayes.score(docs, ["id"], "words", bayes.fit(docs, "label", "words", CLASSES)).collect()}
    # the smoothing mass differs (buckets instead of words), by the same factor for each class and word count
    known = len({w for d in DOCS[:5] if d[1] in CLASSES for w in d[2] or []})
    totals = [sum(len(d[2] or []) for d in DOCS[:5] if d[1] == c) for c in CLASSES]
    for d in DOCS[:5]:
        shift = [len(d[2] or []) * math.log((t + known) / (t + 4096)) for t in totals]
        assert np.allclose(ml[d[0]], np.array(ours[d[0]]) + shift)


@pytest.mark.parametrize("buckets", [10, 16, 256])
def test_tfidf_brute_force(spark, buckets):
    import hashlib

    def bucket(w):
        return int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets

    docs = [d for d in DOCS if d[2]]
    df = spark.createDataFrame(docs, "id long, label string, words array<string>")
    got = {r["id"]: r["features"].toArray() for r in features.tfidf(df, "words", buckets).collect()}
    tf = {d[0]: Counter(map(bucket, d[2])) for d in docs}
    for i, counts in tf.items():
        want = np.zeros(buckets)
        for b, n in counts.items():
            want[b] = n * math.log((len(docs) + 1) / (sum(b in c for c in tf.values()) + 1))
        assert np.allclose(got[i], want)


def test_learners_separate_easy_classes(spark):
    rows = [(i, float(i % 3), [float(i % 3 == k) * 5 + 0.01 * i for k in range(3)], i % 5) for i in range(90)]
    df = learners.as_vectors(spark.createDataFrame(rows, "id long, label double, v array<double>, kfold int"), "v", "label").cache()
    perceptron = learners.perceptron(3, [4], 3, max_iter=60).fit(df)
    assert learners.accuracy(perceptron.transform(df), "prediction") > 0.9
    validated = learners.cross_validate(df, learners.logistic_regression(max_iter=10))
    assert len(validated.subModels) == 5 and validated.avgMetrics[0] > 0.9


def test_fold_models_can_be_saved_and_loaded(spark, tmp_path, vectors):
    df = learners.as_vectors(vectors.withColumn("label", label_encode(F.col("label"), CLASSES)), "v", "label")
    models = [learners.logistic_regression(max_iter=n).fit(df) for n in (2, 4)]
    learners.save_fold_models(models, str(tmp_path / "m"))
    loaded = learners.load_fold_models(str(tmp_path / "m"), 2)
    assert [m.coefficientMatrix.toArray().tolist() for m in loaded] == [m.coefficientMatrix.toArray().tolist() for m in models]


def test_table_models_can_be_saved_and_loaded(spark, tmp_path, vectors):
    from presswork.sources import readers, sinks

    folded = shaping.stratified_kfold(vectors, "label", "id")
    model = linear.fit_kfold_centroids(folded, "label", "v")
    sinks.write_fold_weights(model, str(tmp_path / "w"))
    for kept, read in zip(
        linear.model_arrays(model, "label", CLASSES, "fold"),
        linear.model_arrays(readers.read_fold_weights(spark, str(tmp_path / "w")), "label", CLASSES, "fold"),
    ):
        assert np.array_equal(kept, read)

    docs = spark.createDataFrame(DOCS, "id long, label string, words array<string>")
    fitted = bayes.fit(docs, "label", "words", CLASSES)
    fitted.save(str(tmp_path / "nb"))
    loaded = bayes.BayesModel.load(spark, str(tmp_path / "nb"))
    assert loaded.classes == tuple(CLASSES) and loaded.priors == fitted.priors
    got, want = (
        {r["id"]: r["logits"] for r in bayes.score(docs, ["id"], "words", m).collect()} for m in (loaded, fitted))
    assert got == want


def test_three_models_side_by_side(spark):
    """The logistic label is the one that a plain softmax over the fitted weights gives, and agreement counts equal labels."""
    from presswork.plans import QUERIES, vector_queries

    rows = vector_queries._three_models(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.logistic == r.checked for r in rows)
    side = QUERIES["models_side_by_side"](spark, "/root/testdata/sf0.001").collect()
    assert len(side) == len(rows) and all(r.n_agree == [r.ensemble, r.logistic].count(r.bayes) + 1 for r in side)
    assert sum(r.n_agree == 3 for r in side) > len(side) / 2


def test_three_models_cut_the_texts_once(spark, monkeypatch):
    from presswork.plans import vector_queries

    cuts, kept_docs = [], vector_queries.kept_docs
    monkeypatch.setattr(vector_queries, "kept_docs", lambda *a: cuts.append(a) or kept_docs(*a))
    wide = vector_queries._three_models(spark, "/root/testdata/sf0.001")
    assert len(cuts) == 1 and wide.count() > 0
