"""Training by epochs and hyperband brackets against plain versions."""

import hashlib
import math
import os

import numpy as np
import pytest

from presswork.operators import trainer

rng = np.random.default_rng(5)
N, WIDTH, CLASSES, BATCHES = 240, 3, 3, 2
LABELS = rng.integers(0, CLASSES, N)
ROWS = [(i, (np.eye(3)[LABELS[i]] + rng.normal(0, 0.6, 3)).tolist(), int(LABELS[i]), i % 4) for i in range(N)]
UNUSABLE = [(900, None, 1, 0), (901, [1.0], 1, 0), (902, [1.0, None, 2.0], 1, 1), (903, [1.0, 2.0, 3.0], None, 1), (904, [1.0, 2.0, 3.0], 7, 1),
            (905, [1.0, 2.0, 3.0], 1, None)]


@pytest.fixture(scope="module")
def data(spark):
    frame = spark.createDataFrame(ROWS + UNUSABLE, "id long, v array<double>, label long, fold int")
    return trainer.deal_batches(frame, "id", "v", "label", "fold", BATCHES, CLASSES, WIDTH)


def plain_training(trial, epochs, planned):
    """Log of one trial: {(epoch, batch): (rows, hits, loss)}."""
    batch_of = np.array([int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16) % BATCHES for r in ROWS])
    x, fold = np.array([[1.0, *r[1]] for r in ROWS]), np.array([r[3] for r in ROWS])
    weights, log, step = np.zeros((CLASSES, WIDTH + 1)), {}, 0

    def judge(chosen):
        scores = x[chosen] @ weights.T
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        own = p[np.arange(chosen.sum()), LABELS[chosen]]
        return p, (chosen.sum(), (scores.argmax(1) == LABELS[chosen]).sum(), -np.log(own).sum())

    for epoch in range(1, epochs + 1):
        for batch in range(BATCHES):
            chosen = (batch_of == batch) & (fold != trial.fold)
            p, log[epoch, batch] = judge(chosen)
            gradient = (p - np.eye(CLASSES)[LABELS[chosen]]).T @ x[chosen] / chosen.sum()
            gradient[:, 1:] += trial.decay * weights[:, 1:]
            gradient /= max(1.0, np.linalg.norm(gradient))
            weights = weights - trial.rate * (1 - step / (planned * BATCHES)) * gradient
            step += 1
        log[epoch, None] = judge(fold == trial.fold)[1]
    return log


def stored(spark, path, trial):
    return {(r.epoch, r.batch): (r.n_rows, r.hits, pytest.approx(r.loss, rel=1e-9)) for r in trainer.epoch_log(spark, path).collect() if r.trial == trial}


TRIALS = [trainer.Trial(0, 0, 2.0), trainer.Trial(1, 3, 30.0, 0.05), trainer.Trial(2, 1, 0.1, 0.5)]


@pytest.mark.parametrize("group_bytes", [1 << 20, 1])
def test_log_equals_a_plain_run(spark, data, tmp_path, monkeypatch, group_bytes):
    monkeypatch.setattr(trainer, "GROUP_BYTES", group_bytes)
    trainer.train_epochs(data, TRIALS, str(tmp_path), 3, 5)
    for t in TRIALS:
        assert stored(spark, str(tmp_path), t.number) == plain_training(t, 3, 5)
    assert plain_training(TRIALS[0], 3, 5)[3, None][1] > 40  # of 60


def test_a_broken_run_goes_on_after_its_last_epoch(spark, data, tmp_path):
    path = str(tmp_path)
    trainer.train_epochs(data, TRIALS, path, 2, 4)
    before = os.stat(f"{path}/epoch=2/_SUCCESS").st_mtime_ns
    os.mkdir(f"{path}/epoch=3")  # begun, not finished
    trainer.train_epochs(data, TRIALS[:2], path, 4, 4)
    assert os.stat(f"{path}/epoch=2/_SUCCESS").st_mtime_ns == before
    for t in TRIALS[:2]:
        assert stored(spark, path, t.number) == plain_training(t, 4, 4)
    assert max(e for e, _ in stored(spark, path, 2)) == 2


def test_hyperband_against_plain_brackets(spark, data, tmp_path):
    settings = [(i, 0.02 * 2.3 ** (i % 7), 0.01 * (i % 3)) for i in range(14)]
    rows = trainer.hyperband(data, spark.createDataFrame(settings, "number long, rate double, decay double"), str(tmp_path), 0, 9, 3).collect()
    shares = trainer.brackets(9, 3)
    assert shares == [3, 5, 9]
    want = {}
    draw = lambda i: int(hashlib.md5(f"{i}:bracket".encode()).hexdigest()[:8], 16) / 2 ** 32 * sum(shares)
    dealt = {i: next(s for s in range(3) if draw(i) < sum(shares[:s + 1])) for i, _, _ in settings}
    logs = {i: plain_training(trainer.Trial(i, 0, rate, decay), 9, 9) for i, rate, decay in settings}
    for s in range(3):
        alive = [i for i in dealt if dealt[i] == s]
        for epoch in range(1, 10):
            want.update({(i, epoch): logs[i][epoch, None][2] / 60 for i in alive})
            if epoch < 9 and epoch in [9 // 3 ** k for k in range(s + 1)] and alive:
                limit = sorted(logs[i][epoch, None][2] for i in alive)[math.ceil(len(alive) / 3) - 1]
                alive = [i for i in alive if logs[i][epoch, None][2] <= limit]
    assert {(r.number, r.epoch): pytest.approx(r.loss) for r in rows} == want
    assert {r.number: r.bracket for r in rows} == dealt and len(set(dealt.values())) == 3
    assert {r.number for r in rows if r.state == "COMPLETE"} == {i for i, e in want if e == 9}


def test_nothing_to_train(spark, data, tmp_path):
    none = trainer.hyperband(data, spark.createDataFrame([], "number long, rate double, decay double"), str(tmp_path / "a"), 0)
    assert none.isEmpty() and none.columns == ["number", "bracket", "epoch", "n_rows", "loss", "accuracy", "state"]
    empty = spark.createDataFrame([], "id long, v array<double>, label long, fold int")
    trainer.train_epochs(trainer.deal_batches(empty, "id", "v", "label", "fold", 2, 3, 3), TRIALS[:1], str(tmp_path / "b"), 1, 1)
    assert {v[:2] for v in stored(spark, str(tmp_path / "b"), 0).values()} == {(0, 0)}
