"""Positions, scans, joins, folds and subsets against brute force, with one key holding most rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.operators import corpus, scale, shaping

rng = random.Random(5)
LABELS = [rng.choice(["hot"] * 8 + ["b", "c", "d"]) for _ in range(3000)]


@pytest.fixture(scope="module", autouse=True)
def several_partitions(spark):
    """So little data would otherwise be coalesced into one partition and prove nothing."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.unset(setting)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i * 7 % 3001, label) for i, label in enumerate(LABELS)]
    return spark.createDataFrame(rows, "id long, label string").repartition(16).cache()


def test_with_position(labelled):
    placed = scale.with_position(labelled, F.desc("label"), "id").collect()
    want = sorted(((r["id"], r["label"]) for r in placed), key=lambda r: r[0])
    want = sorted(want, key=lambda r: r[1], reverse=True)
    assert [(r["id"], r["label"]) for r in sorted(placed, key=lambda r: r["pos"])] == want
    assert sorted(r["pos"] for r in placed) == list(range(3000))


def test_sort_splits_the_hot_label(labelled):
    sizes = scale._marked(labelled, ("label", "id")).groupBy("label", "_part").count().collect()
    assert len([r for r in sizes if r["label"] == "hot"]) > 4
    assert max(r["count"] for r in sizes) < 1000


def test_with_position_of_nothing(labelled):
    assert scale.with_position(labelled.filter("id < 0"), "id").count() == 0


def test_prefix_scan(spark):
    values = [rng.randint(-50, 50) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v long").repartition(16)
    got = scale.prefix_scan(df, ["k"], sums={"s": "v"}, maxima={"m": "v"}).orderBy("k").collect()
    assert [r["s"] for r in got] == list(np.cumsum(values))
    assert [r["m"] for r in got] == list(np.maximum.accumulate(values))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_gives_the_same_rows_above_the_broadcast_limit(spark, labelled, how):
    table = spark.createDataFrame([("hot", 1), ("b", 2)], "label string, x int")
    small = scale.lookup_join(labelled, table, ["label"], ["id"], how)
    large = scale.lookup_join(labelled, table, ["label"], ["id"], how, max_rows=1)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    assert "_salt" in large._jdf.queryExecution().toString()
    counted = table.withColumn("_n", F.length("label"))
    for rows in (1, 2, 1000):
        headed = scale.lookup_join(labelled, counted, ["label"], ["id"], how, max_rows=rows, weight="_n", fits=False)
        assert headed.columns == small.columns
        assert sorted(map(tuple, headed.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)


def test_broadcast_needs_few_bytes_too(spark):
    table = spark.createDataFrame([("k" * 1000, [1.0] * 10)], "token string, theta array<double>")
    assert scale.fits_broadcast(table)
    assert not scale.fits_broadcast(table, max_bytes=1000)


def dealt_folds(labels, k):
    """Rows sorted by class (in order of first appearance) are dealt to the folds like cards; what a fold
    was dealt of a class it gets as consecutive rows of that class."""
    classes = list(dict.fromkeys(labels))
    share = {(c, fold): 0 for c in classes for fold in range(k)}
    for card, label in enumerate(sorted(labels, key=classes.index)):
        share[label, card % k] += 1
    hands = {c: iter([fold for fold in range(k) for _ in range(share[c, fold])]) for c in classes}
    return [next(hands[label]) for label in labels]


@pytest.mark.parametrize("k", [2, 5, 7])
def test_kfold_deals_class_sorted_rows(labelled, k):
    rows = shaping.stratified_kfold(labelled, "label", "id", k).orderBy("id").collect()
    assert [r["kfold"] for r in rows] == list(dealt_folds([r["label"] for r in rows], k))


def test_kfold_of_tiny_classes_and_missing_labels(spark):
    labels = ["a", "b", "a", "c", "a", "b", "d", "d", "d", "d", "d", "d", "a"]
    rows = [(i, label, "text") for i, label in enumerate(labels)] + [(99, None, "text")]
    df = spark.createDataFrame(rows, "id long, label string, text string")
    got = shaping.stratified_kfold(df, "label", "id", 5).orderBy("id").collect()
    assert [r["kfold"] for r in got] == [*dealt_folds(labels, 5), None]


def test_kfold_does_not_move_the_rows(spark, labelled, tmp_path):
    labelled.withColumn("text", F.lit("wide")).write.parquet(str(tmp_path / "t"))
    folded = shaping.stratified_kfold(spark.read.parquet(str(tmp_path / "t")), "label", "id")
    executed = folded._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    # the rows' own branch comes first and reaches the scan without an exchange
    assert "BroadcastHashJoin" in executed and "Exchange" not in executed[: executed.index("FileScan")]


def test_fold_invariants(labelled):
    folded = shaping.stratified_kfold(labelled, "label", "id").cache()
    counts = shaping.fold_counts(folded, "label").collect()
    for label in set(LABELS):
        sizes = [r["n_valid"] for r in counts if r["label"] == label]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == LABELS.count(label)
    train, valid = shaping.fold_split(folded, 2)
    assert train.count() + valid.count() == 3000 and train.join(valid, "id").count() == 0


def test_union_keeps_duplicates_and_renumbers(spark):
    a = spark.createDataFrame([(3, "x"), (1, "y")], "id long, v string")
    b = spark.createDataFrame([(1, "y"), (0, "z")], "id long, v string")
    rows = shaping.union_parts([a, b], "id").orderBy("row_ix").collect()
    assert [(r["row_ix"], r["id"], r["v"]) for r in rows] == [(0, 1, "y"), (1, 3, "x"), (2, 0, "z"), (3, 1, "y")]


def test_batches(labelled):
    rows = shaping.assign_batches(labelled.select("id"), "id", 16, seed=1).collect()
    want = sorted((hashlib.md5(f"1:{r['id']}".encode()).hexdigest(), r["id"]) for r in rows)
    by_id = {r["id"]: r for r in rows}
    assert all(by_id[i]["position"] == n and by_id[i]["batch"] == n // 16 for n, (_, i) in enumerate(want))


@pytest.mark.parametrize("per_class", [1, 50, 10_000])
def test_balanced_subset(labelled, per_class):
    got = {(r["label"], r["id"]) for r in corpus.balanced_subset(labelled, "label", "id", per_class, ["hot", "b"]).collect()}
    want = set()
    rows = labelled.collect()
    for label in ("hot", "b"):
        ids = sorted((hashlib.md5(str(r["id"]).encode()).hexdigest(), r["id"]) for r in rows if r["label"] == label)
        want |= {(label, i) for _, i in ids[:per_class]}
    assert got == want


def test_split_is_stable_and_complete(labelled):
    split = labelled.select("id", corpus.split_of(F.col("id")).alias("split"))
    again = labelled.repartition(3).select("id", corpus.split_of(F.col("id")).alias("split"))
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))
    summary = {r["dataset"]: r["n_rows"] for r in corpus.split_summary(split).collect()}
    assert summary["total"] == 3000 == sum(summary[s] for s in corpus.SPLITS)
    assert 0.65 < summary["train"] / 3000 < 0.75
