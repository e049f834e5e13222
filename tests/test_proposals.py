"""Proposals from finished trials against a plain version."""

import math

import pytest

from presswork.operators import tuning

COLUMNS = "number long, value double, lstm_units_1 int, lstm_units_2 int, dense_units int, dropout_rate double, learning_rate double, epochs int, batch_size int"


def trial(number, value, units=64, dense=64, dropout=0.2, rate=1e-3, epochs=10, batch=64):
    return (number, value, units, units // 2 + 16, dense, dropout, rate, epochs, batch)


FINISHED = [trial(i, float(i % 10), dense=64 + 32 * (i % 10), rate=10 ** (-5 + (i % 7) / 2), batch=64 + 32 * (i % 3)) for i in range(30)]
DRAWN = [trial(100 + i, None, dense=64 + 32 * (i % 15), dropout=0.2 + 0.1 * (i % 4), rate=10 ** (-5 + i % 3), epochs=10 + 10 * (i % 3)) for i in range(40)]


def bins(t):
    _, _, first, second, dense, dropout, rate, epochs, batch = t
    half, place = first // 2, (math.log(rate) - math.log(1e-5)) / (math.log(1e-2) - math.log(1e-5))
    return [(first - 64) // 32, (second - half) * 16 // (first - half + 1), (dense - 64) // 32, round((dropout - 0.2) * 10),
            min(max(math.floor(place * 16), 0), 15), (epochs - 10) // 10, (batch - 64) // 32]


def plain(finished, drawn, share=0.25):
    ordered = sorted(finished, key=lambda t: (-t[1], t[0]))
    n = math.ceil(len(ordered) * share)

    def density(group, i, own):
        return (sum(max(0, 3 - abs(bins(t)[i] - own)) for t in group) / 9 + 1 / 16) / (len(group) + 1)

    return {c[0]: sum(math.log(density(ordered[:n], i, b) / density(ordered[n:], i, b)) for i, b in enumerate(bins(c))) for c in drawn}


@pytest.mark.parametrize("finished", [FINISHED, FINISHED[:1], []])
def test_scores_and_order(spark, finished):
    rows = tuning.propose_trials(spark.createDataFrame(finished, COLUMNS), spark.createDataFrame(DRAWN, COLUMNS), 25).collect()
    want = plain(finished, DRAWN)
    order = sorted(want, key=lambda number: (-round(want[number], 6), number))[:25]
    assert [r.number for r in rows] == order
    assert [r.score for r in rows] == [pytest.approx(want[number], abs=2e-6) for number in order]
    assert finished or all(r.score == 0 for r in rows)
    if finished == FINISHED:  # the best had dense layers of 320 or 352
        assert all(DRAWN[r.number - 100][4] in (288, 320, 352, 384) for r in rows[:3])


def test_no_candidates(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert tuning.propose_trials(spark.createDataFrame(FINISHED, COLUMNS), none, 5).isEmpty()
