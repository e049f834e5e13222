"""Reports over predictions for documents and metrics of a training log kept in events."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.operators import evaluate, training_log
from presswork.plans.corpus_queries import LANGS
from presswork.plans.registry import query, table

# Three rules that guess the language; the second never guesses three of the classes.
RULES_SQL = """
rules AS (
  SELECT doc_id, text, lang AS y_true,
         CASE WHEN regexp_matches(text, '[éèêç]') THEN 'fr' WHEN regexp_matches(text, '[äöüß]') THEN 'de'
              WHEN regexp_matches(text, '[óñáí]') THEN 'es' ELSE 'en' END AS accents,
         'en' AS constant,
         CASE WHEN n_chars > 1500 THEN 'en' ELSE 'fr' END AS length
  FROM documents),
preds AS (
  SELECT doc_id, y_true, unnest(['accents', 'constant', 'length']) AS model, unnest([accents, constant, length]) AS y_pred
  FROM rules)
"""

RULES = ("accents", "constant", "length")


def _rules(spark, sf_dir):
    text = F.col("text")
    accents = (
        F.when(text.rlike("[éèêç]"), "fr").when(text.rlike("[äöüß]"), "de").when(text.rlike("[óñáí]"), "es").otherwise("en")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("y_true"), accents.alias("accents"), F.lit("en").alias("constant"),
        F.when(F.col("n_chars") > 1500, "en").otherwise("fr").alias("length"))


def _all_models(spark, sf_dir):
    return _rules(spark, sf_dir).drop("text").unpivot(["doc_id", "y_true"], list(RULES), "model", "y_pred")


def _pairs(spark, sf_dir, model="accents"):
    return evaluate.pair_counts(_rules(spark, sf_dir), predicted=model)


def report_sql(by: str = "") -> str:
    """CTE ``full_report`` from relation ``preds``, optionally per ``by``."""
    b, using = (f"{by}, ", f"USING ({by}, label)") if by else ("", "USING (label)")
    group = f"GROUP BY {by}" if by else ""
    return f"""
labels_seen AS (
  SELECT DISTINCT {b}label FROM (SELECT {b}y_true AS label FROM preds UNION SELECT {b}y_pred FROM preds)),
actual AS (SELECT {b}y_true AS label, count(*) AS n FROM preds GROUP BY ALL),
guessed AS (SELECT {b}y_pred AS label, count(*) AS n FROM preds GROUP BY ALL),
hits AS (SELECT {b}y_true AS label, count(*) AS n FROM preds WHERE y_true = y_pred GROUP BY ALL),
pr AS (
  SELECT {b}label, coalesce(h.n, 0)::double AS tp, coalesce(a.n, 0)::double AS support,
         CASE WHEN coalesce(g.n, 0) = 0 THEN 0.0::double ELSE coalesce(h.n, 0)::double / g.n END AS "precision",
         CASE WHEN coalesce(a.n, 0) = 0 THEN 0.0::double ELSE coalesce(h.n, 0)::double / a.n END AS recall
  FROM labels_seen LEFT JOIN actual a {using} LEFT JOIN guessed g {using} LEFT JOIN hits h {using}),
report AS (
  SELECT *, CASE WHEN "precision" + recall = 0 THEN 0.0::double
                 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1_score FROM pr),
full_report AS (
  SELECT {b}label, "precision", recall, f1_score, support FROM report
  UNION ALL
  SELECT {b}'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support)
  FROM report {group}
  UNION ALL
  SELECT {b}'macro avg', avg("precision"), avg(recall), avg(f1_score), sum(support) FROM report {group}
  UNION ALL
  SELECT {b}'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1_score * support) / sum(support), sum(support) FROM report {group})
"""


ONE_MODEL = f"{RULES_SQL.replace('preds AS', 'all_preds AS')}, preds AS (SELECT * FROM all_preds WHERE model = 'accents')"
ROUNDED = ", ".join(f'round("{m}", 6) AS "{m}"' for m in evaluate.METRICS)


def _rounded(report):
    return report.select(*[
        F.round(c, 6).alias(c) if any(c.endswith(m) for m in evaluate.METRICS) else F.col(c) for c in report.columns])


@query("accuracy", sql=f"""
WITH {ONE_MODEL} SELECT count(*) AS n_rows, round(avg((y_true = y_pred)::int), 6) AS accuracy FROM preds""")
def accuracy(spark, sf_dir):
    return evaluate.accuracy(_rules(spark, sf_dir), predicted="accents").withColumn("accuracy", F.round("accuracy", 6))


@query("confusion_matrix", sql=f"""
WITH {ONE_MODEL}
SELECT c.y_true, {", ".join(f"count(*) FILTER (y_pred = '{c}') AS {c}" for c in LANGS)}
FROM (SELECT unnest(['de', 'en', 'es', 'fr']) AS y_true) c LEFT JOIN preds p USING (y_true) GROUP BY 1""")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_pairs(spark, sf_dir), LANGS)


@query("confusion_long", sql=f"""
WITH {ONE_MODEL}
SELECT a.l AS y_true, b.l AS y_pred, count(p.doc_id) AS n
FROM (SELECT unnest(['de', 'en', 'es', 'fr']) AS l) a CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr']) AS l) b
LEFT JOIN preds p ON p.y_true = a.l AND p.y_pred = b.l GROUP BY ALL""")
def confusion_long(spark, sf_dir):
    return evaluate.confusion_long(_pairs(spark, sf_dir), LANGS)


@query("class_report", sql=f"WITH {ONE_MODEL}, {report_sql()} SELECT label, {ROUNDED} FROM report")
def class_report(spark, sf_dir):
    return _rounded(evaluate.class_report(_pairs(spark, sf_dir)).drop("tp"))


@query("class_report_full", sql=f"WITH {ONE_MODEL}, {report_sql()} SELECT label, {ROUNDED} FROM full_report")
def class_report_full(spark, sf_dir):
    return _rounded(evaluate.class_report_full(_pairs(spark, sf_dir)))


@query("misclassified", sql=f"""
WITH {RULES_SQL} SELECT doc_id, text, y_true, accents AS y_pred FROM rules
WHERE y_true <> accents ORDER BY doc_id LIMIT 15""")
def misclassified(spark, sf_dir):
    rows = _rules(spark, sf_dir).select("doc_id", "text", "y_true", F.col("accents").alias("y_pred"))
    return evaluate.misclassified(rows, "doc_id")


def _percent(label: str, metric: str) -> str:
    return f"printf('%.2f%%', round(max(\"{metric}\") FILTER (label = '{label}') * 100, 2))"


@query("model_comparison", sql=f"""
WITH {RULES_SQL}, {report_sql('model')}
SELECT model, {_percent('weighted avg', 'precision')} AS "Precision", {_percent('weighted avg', 'recall')} AS "Recall",
       {_percent('weighted avg', 'f1_score')} AS "F1_Score", {_percent('accuracy', 'precision')} AS "Accuracy"
FROM full_report GROUP BY model""")
def model_comparison(spark, sf_dir):
    rows = evaluate.class_report(evaluate.pair_counts(_all_models(spark, sf_dir), by=["model"]), by=["model"])
    return evaluate.model_comparison(evaluate.summary_rows(rows, by=["model"]))


@query("report_compare", sql=f"""
WITH {RULES_SQL}, {report_sql('model')},
a AS (SELECT label, {", ".join(f'round("{m}", 6) AS accents_{m}' for m in evaluate.METRICS)} FROM report WHERE model = 'accents'),
b AS (SELECT label, {", ".join(f'round("{m}", 6) AS length_{m}' for m in evaluate.METRICS)} FROM report WHERE model = 'length')
SELECT * FROM a FULL JOIN b USING (label)""")
def report_compare(spark, sf_dir):
    rows = evaluate.class_report(evaluate.pair_counts(_all_models(spark, sf_dir), by=["model"]), by=["model"])
    both = rows.filter(F.col("model").isin("accents", "length"))
    return _rounded(evaluate.report_compare(both, ("accents", "length")))


# --- training log: one event is one example; day of month is the epoch, user the fold ------------

LOG_SQL = """
log AS (
  SELECT event_id, (user_id % 5)::int AS fold, day(ts)::int AS epoch, event_id // 16 AS batch,
         (value < 20)::int AS correct, ln(1 + value) AS loss FROM events)
"""


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 5).cast("int").alias("fold"), F.dayofmonth("ts").alias("epoch"),
        F.floor(F.col("event_id") / 16).alias("batch"), (F.col("value") < 20).cast("int").alias("correct"),
        F.log(1 + F.col("value")).alias("loss"))


@query("best_epoch_per_fold", sql=f"""
WITH {LOG_SQL}, epochs AS (SELECT fold, epoch, avg(correct) AS acc FROM log GROUP BY ALL)
SELECT fold, epoch AS best_epoch, round(acc, 6) AS best_score FROM epochs WHERE acc > 0
QUALIFY row_number() OVER (PARTITION BY fold ORDER BY acc DESC, epoch) = 1""")
def best_epoch_per_fold(spark, sf_dir):
    epochs = _log(spark, sf_dir).groupBy("fold", "epoch").agg(F.avg("correct").alias("acc"))
    best = training_log.best_epoch_per_fold(epochs, "fold", "epoch", "acc")
    return best.withColumn("best_score", F.round("best_score", 6))


@query("running_accuracy", sql=f"""
WITH {LOG_SQL}, batches AS (SELECT batch, sum(correct) AS hits, avg(loss) AS loss FROM log GROUP BY 1),
cum AS (SELECT batch, loss, sum(hits) OVER (ORDER BY batch) AS so_far FROM batches)
SELECT batch, round(loss, 6) AS loss, round(so_far::double / ((batch + 1) * 16), 6) AS accuracy FROM cum WHERE batch % 10 = 0""")
def running_accuracy(spark, sf_dir):
    run = training_log.running_accuracy(_log(spark, sf_dir), "batch", "correct", "loss", batch_size=16, every=10)
    return run.select("batch", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query("epoch_metrics", sql=f"""
WITH {LOG_SQL}, batches AS (SELECT fold, epoch, batch, avg(loss) AS l FROM log GROUP BY ALL),
means AS (SELECT fold, epoch, avg(l) AS loss FROM batches GROUP BY ALL),
rows_ AS (SELECT fold, epoch, count(*) AS n_rows, avg(correct) AS accuracy, avg(loss) AS row_loss FROM log GROUP BY ALL)
SELECT fold, epoch, n_rows, round(accuracy, 6) AS accuracy, round(loss, 6) AS loss, round(row_loss, 6) AS row_loss
FROM rows_ JOIN means USING (fold, epoch)""")
def epoch_metrics(spark, sf_dir):
    metrics = training_log.epoch_metrics(_log(spark, sf_dir), ["fold", "epoch"], "batch", "correct", "loss")
    return metrics.select(
        "fold", "epoch", "n_rows", *[F.round(c, 6).alias(c) for c in ("accuracy", "loss", "row_loss")])
