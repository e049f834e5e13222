import random

import pytest

from presswork.operators import evaluate, training_log, tuning

rng = random.Random(11)
CLASSES = ["a", "b", "c", "d"]
# "d" is never predicted, "e" is never true
PAIRS = [(i, rng.choice("aaabbcd"), rng.choice("aabbce")) for i in range(500)]


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame(PAIRS, "id long, y_true string, y_pred string").cache()


def brute_report():
    labels = sorted({p[1] for p in PAIRS} | {p[2] for p in PAIRS})
    rows = {}
    for c in labels:
        tp = sum(t == p == c for _, t, p in PAIRS)
        support, guessed = sum(t == c for _, t, _ in PAIRS), sum(p == c for *_, p in PAIRS)
        precision = tp / guessed if guessed else 0.0
        recall = tp / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        rows[c] = (precision, recall, f1, float(support))
    return rows


def test_class_report(predictions):
    report = evaluate.class_report_full(evaluate.pair_counts(predictions)).collect()
    got = {r["label"]: tuple(r[m] for m in evaluate.METRICS) for r in report}
    want = brute_report()
    accuracy = sum(t == p for _, t, p in PAIRS) / 500
    rows = list(want.values())
    want["accuracy"] = (accuracy,) * 4
    want["macro avg"] = (*[sum(r[i] for r in rows) / len(rows) for i in range(3)], 500.0)
    want["weighted avg"] = (*[sum(r[i] * r[3] for r in rows) / 500 for i in range(3)], 500.0)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert got["d"][0] == 0.0 and got["e"][1] == 0.0
    # weighted recall is the accuracy
    assert got["weighted avg"][1] == pytest.approx(accuracy)


def test_reports_of_several_models_stay_apart(spark, predictions):
    from pyspark.sql import functions as F

    both = predictions.withColumn("model", F.lit("m1")).unionByName(
        predictions.withColumn("y_pred", F.col("y_true")).withColumn("model", F.lit("m2")))
    rows = evaluate.class_report(evaluate.pair_counts(both, by=["model"]), by=["model"])
    lines = {r["model"]: r for r in evaluate.model_comparison(evaluate.summary_rows(rows, ["model"])).collect()}
    assert lines["m2"]["Accuracy"] == "100.00%"
    assert lines["m1"]["Accuracy"] == f"{sum(t == p for _, t, p in PAIRS) / 5:.2f}%"


def test_confusion(predictions):
    pairs = evaluate.pair_counts(predictions)
    long = {(r["y_true"], r["y_pred"]): r["n"] for r in evaluate.confusion_long(pairs, [*CLASSES, "e"]).collect()}
    assert len(long) == 25 and sum(long.values()) == 500
    wide = {r["y_true"]: r.asDict() for r in evaluate.confusion_matrix(pairs, [*CLASSES, "e"]).collect()}
    assert all(wide[t][p] == sum(a == t and b == p for _, a, b in PAIRS) for t in "abcde" for p in "abcde")


def test_accuracy_of_nothing_is_null(predictions):
    row = evaluate.accuracy(predictions.filter("id < 0")).first()
    assert row["n_rows"] == 0 and row["accuracy"] is None


def test_misclassified_first_rows(predictions):
    got = [r["id"] for r in evaluate.misclassified(predictions, "id").collect()]
    assert got == [i for i, t, p in PAIRS if t != p][:15]


def test_report_compare_keeps_labels_of_both(spark):
    schema = "model string, label string, precision double, recall double, f1_score double, support double"
    rows = spark.createDataFrame([("p", "x", 1.0, 1.0, 1.0, 2.0), ("q", "y", 0.5, 0.5, 0.5, 2.0)], schema)
    got = {r["label"]: (r["p_recall"], r["q_recall"]) for r in evaluate.report_compare(rows, ("p", "q")).collect()}
    assert got == {"x": (1.0, None), "y": (None, 0.5)}


def test_earliest_best_epoch_and_zero_never_saved(spark):
    rows = [(0, 1, 0.5), (0, 2, 0.7), (0, 3, 0.7), (1, 1, 0.0), (1, 2, 0.0)]
    best = training_log.best_epoch_per_fold(
        spark.createDataFrame(rows, "fold int, epoch int, acc double"), "fold", "epoch", "acc").collect()
    assert [tuple(r) for r in best] == [(0, 2, 0.7)]


def test_running_accuracy_counts_a_short_batch_as_full(spark):
    rows = [(i, i // 4, int(i % 3 == 0), float(i)) for i in range(10)]
    log = spark.createDataFrame(rows, "i int, batch long, correct int, loss double")
    got = training_log.running_accuracy(log, "batch", "correct", "loss", batch_size=4, every=1).orderBy("batch").collect()
    hits = [sum(r[2] for r in rows[: (b + 1) * 4]) for b in range(3)]
    assert [r["accuracy"] for r in got] == pytest.approx([h / ((b + 1) * 4) for b, h in enumerate(hits)])


def test_epoch_loss_is_mean_of_batch_means(spark):
    rows = [(1, 0, 1, 1.0), (1, 0, 0, 3.0), (1, 1, 1, 8.0)]
    log = spark.createDataFrame(rows, "epoch int, batch long, correct int, loss double")
    row = training_log.epoch_metrics(log, ["epoch"], "batch", "correct", "loss").first()
    assert (row["loss"], row["row_loss"], row["accuracy"]) == (5.0, 4.0, pytest.approx(2 / 3))


def test_search_space_bounds(spark):
    rows = tuning.search_space(spark.range(2000).withColumnRenamed("id", "number")).collect()
    assert {r["lstm_units_1"] for r in rows} == set(range(64, 513, 32))
    assert {r["dense_units"] for r in rows} == set(range(64, 513, 32))
    assert {r["dropout_rate"] for r in rows} == {0.2, 0.3, 0.4, 0.5}
    assert {r["epochs"] for r in rows} == {10, 20, 30}
    assert {r["batch_size"] for r in rows} == set(range(64, 257, 32))
    assert all(1e-5 <= r["learning_rate"] <= 1e-2 for r in rows)
    for r in rows:
        half = r["lstm_units_1"] // 2
        assert half <= r["lstm_units_2"] <= r["lstm_units_1"] and (r["lstm_units_2"] - half) % 32 == 0


def test_halving_keeps_ties_and_handles_a_hot_rung(spark):
    rows = [(i, "hot" if i % 5 else "small", float(rng.randint(0, 40))) for i in range(1000)]
    log = spark.createDataFrame(rows, "number long, rung string, loss double")
    got = {r["number"] for r in tuning.halving_rung(log, "rung", "loss", "number", eta=4).collect()}
    want = set()
    for rung in ("hot", "small"):
        members = [r for r in rows if r[1] == rung]
        limit = sorted(r[2] for r in members)[-(-len(members) // 4) - 1]
        want |= {r[0] for r in members if r[2] <= limit}
    assert got == want


def test_best_trial_and_history(spark):
    # The published best value and the parameters it was reached with.
    best_value = 0.886130690574646
    rows = [(0, 0.8729, "COMPLETE"), (8, 0.99, "PRUNED"), (26, best_value, "COMPLETE"), (40, best_value, "COMPLETE"), (43, 0.87, "COMPLETE")]
    log = spark.createDataFrame(rows, "number long, value double, state string")
    assert tuning.best_trial(log).first()["number"] == 26
    history = tuning.optimization_history(tuning.complete_trials(log)).orderBy("number").collect()
    assert [r["best_so_far"] for r in history] == [0.8729, best_value, best_value, best_value]
    assert {r["state"]: r["n_trials"] for r in tuning.trial_states(log).collect()} == {"COMPLETE": 4, "PRUNED": 1}


def test_successive_halving_carries_survivors_on(spark):
    draw = random.Random(3)
    reports = [(n, rung, draw.choice([1.0, 2.0, 3.0, draw.random()])) for n in range(40) for rung in range(3)]
    table = spark.createDataFrame(reports, "number long, rung int, loss double")
    got = {(r.number, r.rung): r.survives for r in tuning.successive_halving(table, (0, 1, 2), "rung", "loss", "number", eta=3).collect()}
    losses = {(n, rung): loss for n, rung, loss in reports}
    alive, want = set(range(40)), {}
    for rung in range(3):
        limit = sorted(losses[n, rung] for n in alive)[-(-len(alive) // 3) - 1]
        want |= {(n, rung): losses[n, rung] <= limit for n in alive}
        alive = {n for n in alive if want[n, rung]}
    assert got == want
