"""Features, classifiers and scoring over documents and embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from presswork.functions.labels import label_decode, label_encode
from presswork.functions.scores import cross_entropy, softmax
from presswork.operators import bayes, corpus, dense, features, learners, linear, scoring, shaping
from presswork.plans import sql_text as s
from presswork.plans.corpus_queries import LANGS
from presswork.plans.registry import query, table
from presswork.plans.text_queries import KEPT, kept_docs
from presswork.session import materialise, scratch_path
from presswork.streaming.score_stream import score_stream

BUCKETS = 256
DENSE = 32
DIM = 64
LABELS = list(range(10))


# --- text features ---------------------------------------------------------------------------

TFIDF = f"""
{KEPT},
bucketed AS (
  SELECT doc_id, {s.hash8('token')} % {BUCKETS} AS bucket, count(*) AS tf
  FROM (SELECT doc_id, unnest(words) AS token FROM kept) GROUP BY ALL),
idf AS (
  SELECT bucket, ln(((SELECT count(*) FROM kept) + 1.0::double) / (count(*) + 1.0::double)) AS w FROM bucketed GROUP BY 1),
weighted AS (SELECT doc_id, bucket, tf * w AS value FROM bucketed JOIN idf USING (bucket) WHERE tf * w <> 0)
"""


def _tfidf(spark, sf_dir, *columns):
    return features.tfidf(kept_docs(spark, sf_dir, *columns), "words", BUCKETS)


def _long(tfidf):
    return features.nonzero(features.store_sparse(tfidf, "features"), "doc_id", "features", "value")


@query("tfidf_features", sql=f"""
WITH {TFIDF} SELECT doc_id, bucket::int AS bucket, round(value, 6) AS value FROM weighted""")
def tfidf_features(spark, sf_dir):
    return _long(_tfidf(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("ml_tfidf", sql=f"""
WITH {KEPT} SELECT doc_id, len(words)::double AS n_terms, {BUCKETS} AS dim, true AS weighted FROM kept""")
def ml_tfidf(spark, sf_dir):
    """Spark ML's own hash has no twin in SQL: its term counts must add up to the words, and its weights stay finite."""
    rows = features.store_sparse(features.ml_tfidf(kept_docs(spark, sf_dir), "words", BUCKETS, keep_counts="tf"), "tf", "features")
    total = F.aggregate("tf.values", F.lit(0.0), lambda a, x: a + x)
    finite = F.forall("features.values", lambda x: (x >= 0) & ~F.isnan(x))
    same = F.size("tf.indices") == F.size("features.indices")
    return rows.select("doc_id", total.alias("n_terms"), F.col("features.size").alias("dim"), (finite & same).alias("weighted"))


def feature_rows(spark, sf_dir, kept=None):
    """``(doc_id, split, category, y, features)`` in one narrow pass over the documents, or over their ``kept`` words."""
    rows = _tfidf(spark, sf_dir, "lang") if kept is None else features.tfidf(kept.select("doc_id", "words", "lang"), "words", BUCKETS)
    return rows.select(
        "doc_id", corpus.split_of(F.col("doc_id")).alias("split"), F.col("lang").alias("category"),
        label_encode(F.col("lang"), LANGS).alias("y"), "features")


def _summed(rows):
    """Rows with stored sparse ``features`` (size, indices, values)."""
    return rows.select(
        "doc_id", "split", "category", "y", F.col("features.size").alias("dim"),
        F.size(F.filter("features.values", lambda x: x != 0)).alias("n_nonzero"),
        F.round(F.aggregate("features.values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


FEATURE_TABLE = f"""
WITH {TFIDF}
SELECT k.doc_id, {s.split_of('k.doc_id')} AS split, lang AS category,
       CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE -1 END AS y,
       {BUCKETS} AS dim, count(w.bucket)::int AS n_nonzero, round(coalesce(sum(w.value), 0), 4) AS total
FROM kept k LEFT JOIN weighted w USING (doc_id) GROUP BY k.doc_id, lang"""


@query("feature_table", sql=FEATURE_TABLE)
def feature_table(spark, sf_dir):
    return _summed(features.store_sparse(feature_rows(spark, sf_dir), "features"))


@query("feature_shapes", sql=f"""
SELECT {s.split_of('vec_id')} AS split, count(*) AS n_rows, min(len(embedding))::int AS min_dim,
       max(len(embedding))::int AS max_dim FROM embeddings GROUP BY 1""")
def feature_shapes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("split", corpus.split_of(F.col("vec_id")))
    return features.feature_shapes(rows, "split", "embedding")


@query("dense_features")
def dense_features(spark, sf_dir):
    """Each document as 32 numbers, by the leading directions of the training rows' features, and the share of its length that they hold.

    The basis is made of floating-point sums without a twin in SQL; the tests hold it against an exact decomposition."""
    rows = features.store_sparse(feature_rows(spark, sf_dir), "features")
    projection = dense.fit_projection(rows.filter("split = 'train'"), "features", BUCKETS, DENSE)
    found = dense.with_dense(rows, "features", projection)
    return found.select("doc_id", "split", "category", "y", F.transform("dense", lambda x: F.round(x, 6)).alias("features"),
                        F.round("kept", 6).alias("kept"))


# --- centroid models -------------------------------------------------------------------------

EMB = f"""
labelled AS (SELECT vec_id, label FROM embeddings),
{s.kfold('labelled', 'label', 'vec_id')},
emb AS (
  SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
centroids AS (
  SELECT f.fold, e.label, i, avg(x) AS mu, count(*) AS n
  FROM emb e JOIN folded d USING (vec_id), (SELECT unnest(range(5))::int AS fold) f
  WHERE d.kfold <> f.fold GROUP BY ALL),
biases AS (SELECT fold, label, -0.5::double * sum(mu * mu) AS bias FROM centroids GROUP BY ALL),
logits AS (
  SELECT vec_id, fold AS model, c.label AS class_ix, sum(x * mu) + max(bias) AS logit
  FROM emb e JOIN centroids c USING (i) JOIN biases b USING (fold)
  WHERE b.label = c.label GROUP BY ALL),
mean_logits AS (SELECT vec_id, class_ix, avg(logit) AS logit FROM logits GROUP BY ALL),
exps AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM mean_logits),
conf AS (SELECT vec_id, class_ix, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM exps)
"""


def _folded_embeddings(spark, sf_dir):
    return shaping.stratified_kfold(table(spark, sf_dir, "embeddings"), "label", "vec_id")


def _long_centroids(model, *keys):
    return model.select(*keys, "n", F.posexplode("mu").alias("i", "mu"), F.round("bias", 6).alias("bias")) \
        .withColumn("mu", F.round("mu", 6))


@query("centroid_fit", sql="""
WITH emb AS (
  SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1)::int - 1 AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS mu, count(*) AS n FROM emb GROUP BY ALL)
SELECT label, n, i, round(mu, 6) AS mu, round(-0.5::double * sum(mu * mu) OVER (PARTITION BY label), 6) AS bias FROM c""")
def centroid_fit(spark, sf_dir):
    model = linear.fit_centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return _long_centroids(model, "label")


@query("kfold_centroids", sql=f"""
WITH {EMB} SELECT fold, label, n, i::int AS i, round(mu, 6) AS mu, round(bias, 6) AS bias
FROM centroids JOIN biases USING (fold, label)""")
def kfold_centroids(spark, sf_dir):
    model = linear.fit_kfold_centroids(_folded_embeddings(spark, sf_dir), "label", "embedding")
    return _long_centroids(model, "fold", "label")


def _scored_embeddings(spark, sf_dir):
    model = linear.fit_kfold_centroids(_folded_embeddings(spark, sf_dir), "label", "embedding")
    weights, bias = linear.model_arrays(model, "label", LABELS, "fold")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return linear.score_vectors(rows, "embedding", weights, bias)


@query("ensemble_mean_logits", sql=f"WITH {EMB} SELECT vec_id, class_ix, round(logit, 6) AS logit FROM mean_logits")
def ensemble_mean_logits(spark, sf_dir):
    # the mean over the models is already in the row
    long = _scored_embeddings(spark, sf_dir).select("vec_id", F.posexplode_outer("logits").alias("class_ix", "logit"))
    return long.withColumn("logit", F.round("logit", 6))


@query("softmax_confidence", sql=f"WITH {EMB} SELECT vec_id, class_ix, round(p, 6) AS confidence FROM conf")
def softmax_confidence(spark, sf_dir):
    scored = _scored_embeddings(spark, sf_dir).select("vec_id", softmax(F.col("logits")).alias("p"))
    return scored.select("vec_id", F.posexplode_outer("p").alias("class_ix", "confidence")) \
        .withColumn("confidence", F.round("confidence", 6))


@query("predict_label", sql=f"""
WITH {EMB} SELECT vec_id, class_ix AS predicted FROM mean_logits
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, class_ix) = 1""")
def predict_label(spark, sf_dir):
    return _scored_embeddings(spark, sf_dir).select(
        "vec_id", scoring.predicted_label(F.col("logits"), LABELS).alias("predicted"))


WIDE = ", ".join(f"round(max(p) FILTER (class_ix = {c}), 6) AS \"{c}\"" for c in LABELS)


def _confidence_wide(spark, sf_dir):
    wide = scoring.confidence_wide(_scored_embeddings(spark, sf_dir), ["vec_id"], "logits", LABELS)
    return wide.select("vec_id", *[F.round(str(c), 6).alias(str(c)) for c in LABELS])


@query("confidence_wide", sql=f"WITH {EMB} SELECT vec_id, {WIDE} FROM conf GROUP BY 1")
def confidence_wide(spark, sf_dir):
    return _confidence_wide(spark, sf_dir)


@query("confidence_long", sql=f"""
WITH {EMB} SELECT vec_id, class_ix::varchar AS "Label", round(p, 6) AS "Confidence" FROM conf""")
def confidence_long(spark, sf_dir):
    return scoring.confidence_long(_confidence_wide(spark, sf_dir), ["vec_id"], LABELS)


@query("cross_entropy", sql=f"""
WITH {EMB} SELECT c.vec_id, round(-ln(p), 6) AS loss FROM conf c JOIN embeddings e ON e.vec_id = c.vec_id AND e.label = class_ix""")
def cross_entropy_rows(spark, sf_dir):
    return _scored_embeddings(spark, sf_dir).select(
        "vec_id", F.round(cross_entropy(F.col("logits"), F.col("label")), 6).alias("loss"))


@query("compare_predictions", sql=f"""
WITH {EMB},
best AS (
  SELECT vec_id, class_ix AS ensemble FROM mean_logits
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, class_ix) = 1),
single AS (
  SELECT vec_id, model, class_ix FROM logits
  QUALIFY row_number() OVER (PARTITION BY vec_id, model ORDER BY logit DESC, class_ix) = 1)
SELECT b.vec_id, ensemble, f.class_ix AS first_fold, l.class_ix AS last_fold,
       (ensemble = f.class_ix AND ensemble = l.class_ix) AS agree
FROM best b JOIN single f ON f.vec_id = b.vec_id AND f.model = 0 JOIN single l ON l.vec_id = b.vec_id AND l.model = 4""")
def compare_predictions(spark, sf_dir):
    scored = _scored_embeddings(spark, sf_dir)
    logits = {"ensemble": F.col("logits"), "first_fold": F.get("model_logits", F.lit(0)),
              "last_fold": F.get("model_logits", F.lit(4))}
    columns = [scoring.predicted_label(values, LABELS).alias(name) for name, values in logits.items()]
    return scoring.with_agreement(scored.select("vec_id", *columns), list(logits))


# --- naive Bayes on text ---------------------------------------------------------------------

def _each(template: str, separator: str = ", ") -> str:
    return separator.join(template.format(c=c) for c in LANGS)


NB = f"""
{KEPT},
train AS (SELECT * FROM kept WHERE {s.split_of('doc_id')} = 'train'),
word_counts AS (
  SELECT token, {_each("count(*) FILTER (lang = '{c}') AS n_{c}")}
  FROM (SELECT lang, unnest(words) AS token FROM train) GROUP BY 1),
word_totals AS (SELECT count(*)::double AS v, {_each("sum(n_{c})::double AS t_{c}")} FROM word_counts),
theta AS (
  SELECT token, {_each("ln((n_{c} + 1.0::double) / (t_{c} + v)) AS theta_{c}")} FROM word_counts, word_totals),
priors AS (
  SELECT {_each("ln((count(*) FILTER (lang = '{c}') + 1.0::double) / (count(*) + 4.0::double)) AS prior_{c}")} FROM train)
"""


def nb_scored(source: str, *keys: str) -> str:
    """CTEs ending in ``nb_pred`` for a relation ``source (keys..., words)``."""
    k = ", ".join(keys)
    return f"""
nb_sums AS (
  SELECT {k}, {_each("sum(theta_{c}) AS s_{c}")}
  FROM (SELECT {k}, unnest(words) AS token FROM {source}) LEFT JOIN theta USING (token) GROUP BY ALL),
nb_long AS (
  SELECT {k}, unnest([{_each("'{c}'")}]) AS label,
         unnest([{_each("coalesce(s_{c}, 0) + prior_{c}")}]) AS logit
  FROM (SELECT {k} FROM {source}) LEFT JOIN nb_sums USING ({k}), priors),
nb_conf AS (
  SELECT *, exp(logit - max(logit) OVER (PARTITION BY {k})) AS e FROM nb_long),
nb_pred AS (
  SELECT {k}, label AS y_pred, e / sum(e) OVER (PARTITION BY {k}) AS confidence FROM nb_conf
  QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY logit DESC, label) = 1)
"""


def _split_docs(spark, sf_dir, kept=None):
    kept = kept_docs(spark, sf_dir, "lang") if kept is None else kept.select("doc_id", "words", "lang")
    return kept.withColumn("split", corpus.split_of(F.col("doc_id")))


def _nb_model(spark, sf_dir, kept=None):
    return bayes.fit(_split_docs(spark, sf_dir, kept).filter(F.col("split") == "train"), "lang", "words", LANGS)


@query("nb_fit", sql=f"WITH {NB} SELECT token, {_each('round(theta_{c}, 6) AS theta_{c}')} FROM theta")
def nb_fit(spark, sf_dir):
    model = _nb_model(spark, sf_dir)
    return model.table.select(
        "token", *[F.round(F.get("theta", F.lit(i)), 6).alias(f"theta_{c}") for i, c in enumerate(LANGS)])


def _labelled(scored, *columns):
    return scored.select(
        *columns, scoring.predicted_label(F.col("logits"), LANGS).alias("y_pred"),
        F.round(F.array_max(softmax(F.col("logits"))), 6).alias("confidence"))


TEST_SCORES = f"""
WITH {NB},
test AS (SELECT * FROM kept WHERE {s.split_of('doc_id')} = 'test'),
{nb_scored('test', 'doc_id')}
SELECT doc_id, lang AS y_true, y_pred, round(confidence, 6) AS confidence FROM nb_pred JOIN test USING (doc_id)"""


def test_set_predictions(spark, sf_dir, kept=None):
    model = _nb_model(spark, sf_dir, kept)
    test = _split_docs(spark, sf_dir, kept).filter(F.col("split") == "test")
    scored = bayes.score(test, ["doc_id", "lang"], "words", model)
    return _labelled(scored, "doc_id", F.col("lang").alias("y_true"))


@query("score_test_set", sql=TEST_SCORES)
def score_test_set(spark, sf_dir):
    return test_set_predictions(spark, sf_dir)


NB_BUCKETS = 1 << 16

HASHED_NB = f"""
WITH {KEPT},
words AS (
  SELECT doc_id, lang, {s.hash8('token')} % {NB_BUCKETS} AS bucket, {s.split_of('doc_id')} AS split
  FROM (SELECT doc_id, lang, unnest(words) AS token FROM kept)),
bucket_counts AS (
  SELECT bucket, {_each("count(*) FILTER (lang = '{c}') AS n_{c}")} FROM words WHERE split = 'train' GROUP BY 1),
totals AS (SELECT {_each("coalesce(sum(n_{c}), 0)::double AS t_{c}")} FROM bucket_counts),
sums AS (
  SELECT doc_id, {_each("sum(ln((coalesce(n_{c}, 0) + 1.0::double) / (t_{c} + 65536.0))) AS s_{c}")}
  FROM words LEFT JOIN bucket_counts USING (bucket), totals WHERE split = 'test' GROUP BY 1),
priors AS (
  SELECT {_each("ln((count(*) FILTER (lang = '{c}') + 1.0::double) / (count(*) + 4.0::double)) AS prior_{c}")}
  FROM kept WHERE {s.split_of('doc_id')} = 'train'),
hashed_long AS (
  SELECT k.doc_id, lang, unnest([{_each("'{c}'")}]) AS label, unnest([{_each("coalesce(s_{c}, 0) + prior_{c}")}]) AS logit
  FROM kept k LEFT JOIN sums USING (doc_id), priors WHERE {s.split_of('k.doc_id')} = 'test')
SELECT doc_id, lang AS y_true, label AS y_pred FROM hashed_long
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY logit DESC, label) = 1"""


@query("ml_naive_bayes", sql=HASHED_NB)
def ml_naive_bayes(spark, sf_dir):
    coded = _split_docs(spark, sf_dir).withColumn("y", label_encode(F.col("lang"), LANGS).cast("double"))
    counts = features.hashed_counts(coded, "words", NB_BUCKETS, "features").drop("words")
    docs = materialise(counts, "word-counts")  # read by the classifier and the scoring
    model = learners.text_bayes(docs.filter(F.col("split") == "train"), "y")
    scored = model.transform(docs.filter(F.col("split") == "test"))
    return scored.select(
        "doc_id", F.col("lang").alias("y_true"), label_decode(F.col("prediction").cast("int"), LANGS).alias("y_pred"))


KFOLD_NB = f"""
{KEPT},
{s.kfold('kept', 'lang', 'doc_id')},
fold_words AS MATERIALIZED (
  SELECT token, kfold, {_each("count(*) FILTER (lang = '{c}') AS n_{c}")}
  FROM (SELECT kfold, lang, unnest(words) AS token FROM folded) GROUP BY ALL),
all_words AS MATERIALIZED (SELECT token, {_each("sum(n_{c}) AS n_{c}")} FROM fold_words GROUP BY 1),
rest AS MATERIALIZED (
  SELECT a.token, f.fold, {_each("a.n_{c} - coalesce(w.n_{c}, 0) AS n_{c}")}
  FROM all_words a CROSS JOIN (SELECT unnest(range(5))::int AS fold) f LEFT JOIN fold_words w ON w.token = a.token AND w.kfold = f.fold
  WHERE {_each("a.n_{c} - coalesce(w.n_{c}, 0)", " + ")} > 0),
fold_totals AS (SELECT fold, count(*)::double AS v, {_each("sum(n_{c})::double AS t_{c}")} FROM rest GROUP BY 1),
theta AS MATERIALIZED (
  SELECT token, fold, {_each("ln((n_{c} + 1.0::double) / (t_{c} + v)) AS theta_{c}")} FROM rest JOIN fold_totals USING (fold)),
priors AS (
  SELECT f.fold, {_each("ln((count(*) FILTER (lang = '{c}' AND kfold <> f.fold) + 1.0::double) / (count(*) FILTER (kfold <> f.fold) + 4.0::double)) AS prior_{c}")}
  FROM folded CROSS JOIN (SELECT unnest(range(5))::int AS fold) f GROUP BY 1),
fold_sums AS (
  SELECT doc_id, fold, {_each("sum(theta_{c}) AS s_{c}")}
  FROM (SELECT doc_id, unnest(words) AS token FROM folded) JOIN theta USING (token) GROUP BY ALL),
fold_logits AS (
  SELECT doc_id, lang, kfold, p.fold, {_each("coalesce(s_{c}, 0) + prior_{c} AS l_{c}")}
  FROM folded CROSS JOIN priors p LEFT JOIN fold_sums x USING (doc_id, fold))
"""
BEST_OF = "CASE " + " ".join(
    f"WHEN l_{c} >= greatest({', '.join(f'l_{o}' for o in LANGS)}) THEN '{c}'" for c in LANGS) + " END"


def _folded_words(spark, sf_dir):
    # folds are made from keys and labels; the stored word lists are read for fitting and for scoring
    return materialise(shaping.stratified_kfold(kept_docs(spark, sf_dir, "lang"), "lang", "doc_id"), "folded-words")


def _kfold_bayes(spark, sf_dir, folded=None):
    folded = _folded_words(spark, sf_dir) if folded is None else folded
    return bayes.score_kfold(folded, ["doc_id", "lang", "kfold"], "words", bayes.fit_kfold(folded, "lang", "words", LANGS))


@query("kfold_bayes", sql=f"""
WITH {KFOLD_NB} SELECT kfold, count(*) AS n_rows, round(avg(({BEST_OF} = lang)::int), 6) AS accuracy
FROM fold_logits WHERE fold = kfold GROUP BY 1""")
def kfold_bayes(spark, sf_dir):
    """Accuracy of each fold's model on the rows it has not seen."""
    own = scoring.predicted_label(F.get("model_logits", F.col("kfold")), LANGS)
    hit = _kfold_bayes(spark, sf_dir).select("kfold", (own == F.col("lang")).cast("int").alias("hit"))
    return hit.groupBy("kfold").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("hit"), 6).alias("accuracy"))


@query("ensemble_bayes", sql=f"""
WITH {KFOLD_NB}, mean_rows AS (SELECT doc_id, {_each("avg(l_{c}) AS l_{c}")} FROM fold_logits GROUP BY 1)
SELECT doc_id, {BEST_OF} AS y_pred, {_each("round(l_{c}, 4) AS logit_{c}")} FROM mean_rows""")
def ensemble_bayes(spark, sf_dir):
    return _kfold_bayes(spark, sf_dir).select(
        "doc_id", scoring.predicted_label(F.col("logits"), LANGS).alias("y_pred"),
        *[F.round(F.get("logits", F.lit(i)), 4).alias(f"logit_{c}") for i, c in enumerate(LANGS)])


def _renamed(sql: str, *names: str) -> str:
    """The SQL with its tables ``names`` called ``fold_...``, to stand next to the single model's."""
    for name in names:
        sql = sql.replace(f"\n{name} AS", f"\nfold_{name} AS").replace(f"JOIN {name} ", f"JOIN fold_{name} ")
    return sql


def _three_models(spark, sf_dir):
    """Three models of different jobs side by side on the test split: word counts of the training split, the k-fold
    ensemble, and logistic regression on tf-idf, whose label is compared with the one recomputed from its weights."""
    kept = _folded_words(spark, sf_dir)  # texts are cut into words once, for all three models
    single = test_set_predictions(spark, sf_dir, kept).select("doc_id", F.lit("bayes").alias("model"), F.col("y_pred").alias("label"))
    test_keys = corpus.split_of(F.col("doc_id")) == "test"
    folds = _kfold_bayes(spark, sf_dir, kept).filter(test_keys).select(
        "doc_id", F.lit("ensemble").alias("model"), scoring.predicted_label(F.col("logits"), LANGS).alias("label"))
    rows = materialise(feature_rows(spark, sf_dir, kept).select(
        "doc_id", "split", F.col("y").cast("double").alias("y"), "features"), "text-features")
    model = learners.logistic_regression(max_iter=20).fit(rows.filter(F.col("split") == "train"))
    scored = learners.with_recomputed(model.transform(rows.filter(F.col("split") == "test")), model)
    named = lambda column, name: scored.select(
        "doc_id", F.lit(name).alias("model"), label_decode(F.col(column).cast("int"), LANGS).alias("label"))
    long = reduce(lambda a, b: a.unionByName(b), [single, folds, named("prediction", "logistic"), named("recomputed", "checked")])
    return scoring.compare_predictions(long, "doc_id", ["bayes", "ensemble", "logistic", "checked"])


@query("compare_models", sql=f"""
WITH {_renamed(KFOLD_NB, "theta", "priors")},
{NB.replace(KEPT + ",", "", 1)},
test AS (SELECT * FROM kept WHERE {s.split_of('doc_id')} = 'test'),
{nb_scored('test', 'doc_id')},
mean_rows AS (SELECT doc_id, {_each("avg(l_{c}) AS l_{c}")} FROM fold_logits GROUP BY 1)
SELECT doc_id, y_pred AS bayes, {BEST_OF} AS ensemble, true AS logistic_checked, (y_pred = {BEST_OF}) AS bayes_agree
FROM nb_pred JOIN mean_rows USING (doc_id)""")
def compare_models(spark, sf_dir):
    """Two word models side by side on the test split, and whether the logistic label next to them is the recomputed one."""
    wide = _three_models(spark, sf_dir)
    return wide.select("doc_id", "bayes", "ensemble", (F.col("logistic") == F.col("checked")).alias("logistic_checked"),
                       (F.col("bayes") == F.col("ensemble")).alias("bayes_agree"))


@query("models_side_by_side")
def models_side_by_side(spark, sf_dir):
    """The labels of all three models for each text of the test split, and how many of them agree with the first."""
    wide = _three_models(spark, sf_dir)
    agree = sum((F.col(m) == F.col("bayes")).cast("int") for m in ("ensemble", "logistic"))
    return wide.select("doc_id", "bayes", "ensemble", "logistic", (agree + 1).alias("n_agree"))


@query("stream_score", sql=f"""
WITH {NB}, talks AS (SELECT conv_id, turn, {s.kept('text')} AS words FROM conversations),
{nb_scored('talks', 'conv_id', 'turn')}
SELECT conv_id, turn, y_pred, round(confidence, 6) AS confidence FROM nb_pred""")
def stream_score(spark, sf_dir):
    from presswork.functions.text import kept_words

    model = _nb_model(spark, sf_dir)
    out = scratch_path(spark, "stream-scores")

    def score(batch):
        texts = batch.select("conv_id", "turn", kept_words(F.col("text")).alias("words"))
        return _labelled(bayes.score(texts, ["conv_id", "turn"], "words", model), "conv_id", "turn")

    # a file source watches a folder or a pattern, not a single file
    score_stream(spark, f"{sf_dir}/conversations*.parquet", table(spark, sf_dir, "conversations").schema, score, out,
                 scratch_path(spark, "stream-checkpoint"))
    return spark.read.parquet(out).drop("batch_id")


# --- Spark ML --------------------------------------------------------------------------------

def _ml_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("split", corpus.split_of(F.col("vec_id")))
    return learners.as_vectors(rows, "embedding", "label").select("vec_id", "split", "features", "y")


def _fit_and_report(spark, sf_dir, estimator, settled):
    rows = _ml_embeddings(spark, sf_dir)
    train = materialise(rows.filter(F.col("split") == "train"), "train-vectors")  # read in every iteration
    model = estimator.fit(train)
    checked = learners.with_recomputed(model.transform(rows), model)
    return learners.agreement_by(checked, "split").withColumn("settled", F.lit(settled(model, train)))


PER_SPLIT = f"SELECT {s.split_of('vec_id')} AS split, count(*) AS n_rows, true AS same, true AS settled FROM embeddings GROUP BY 1"


@query("train_logreg", sql=PER_SPLIT)
def train_logreg(spark, sf_dir):
    """Predictions must equal the largest class score computed from the coefficients, and the penalised gradient must vanish."""
    return _fit_and_report(spark, sf_dir, learners.logistic_regression(max_iter=300, tol=1e-7),
                           lambda model, train: learners.gradient_size(model, train) < 1e-4)


@query("train_mlp", sql=PER_SPLIT)
def train_mlp(spark, sf_dir):
    """Predictions must equal a forward pass from the weights, and the loss must beat class shares alone."""
    return _fit_and_report(spark, sf_dir, learners.perceptron(DIM, [32], len(LABELS)), learners.beats_class_shares)


@query("kfold_logreg", sql=f"""
WITH src AS (SELECT vec_id, label FROM embeddings), {s.kfold('src', 'label', 'vec_id')}
SELECT kfold, count(*) AS n_rows, true AS same, true AS settled FROM folded GROUP BY 1""")
def kfold_logreg(spark, sf_dir):
    rows = learners.as_vectors(_folded_embeddings(spark, sf_dir), "embedding", "label")
    # stored once: every fold and every iteration reads it again
    rows = materialise(rows.select("vec_id", "kfold", "features", "y"), "folded-vectors")
    validated = learners.cross_validate(rows, learners.logistic_regression(max_iter=300, tol=1e-7))
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            learners.agreement_by(
                learners.with_recomputed(models[0].transform(rows.filter(F.col("kfold") == fold)), models[0]), "kfold")
            .withColumn("settled", F.lit(learners.gradient_size(models[0], rows.filter(F.col("kfold") != fold)) < 1e-4))
            for fold, models in enumerate(validated.subModels)
        ],
    )


@query("tune_logreg", sql=f"""
SELECT {s.split_of('doc_id')} AS split, count(*) AS n_rows, true AS same, true AS best FROM documents GROUP BY 1""")
def tune_logreg(spark, sf_dir):
    """Every trial's accuracy is compared again with the winner's, from recomputed predictions."""
    docs = materialise(
        feature_rows(spark, sf_dir).select("doc_id", "split", F.col("y").cast("double").alias("y"), "features"), "text-features")
    estimator = learners.logistic_regression(max_iter=10)
    grid = ParamGridBuilder().addGrid(estimator.regParam, [0.001, 0.01, 0.1]).build()
    train, validation = (docs.filter(F.col("split") == name) for name in ("train", "validation"))
    results = learners.tune(train, validation, estimator, grid)
    number, value, best = max(results, key=lambda r: (r[1], -r[0]))
    again = [learners.accuracy(learners.with_recomputed(model.transform(validation), model)) for _, _, model in results]
    report = learners.agreement_by(learners.with_recomputed(best.transform(docs), best), "split")
    return report.withColumn("best", F.lit(abs(again[number] - value) < 1e-9 and max(again) <= again[number] + 1e-9))
