"""Embedding near-duplicates against all cosines of a fixture with planted copies."""

import numpy as np
import pytest

from presswork.llm import embedding

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id string, copies string, root string"


def planted(seed, dims, groups, alone, spread):
    """Groups around a centre whose cosines spread around the threshold, and single vectors."""
    random = np.random.default_rng(seed)
    rows = []
    for size, label in groups:
        centre = random.standard_normal(dims)
        centre /= np.linalg.norm(centre)
        rows += [(centre + spread * random.standard_normal(dims) / np.sqrt(dims), label) for _ in range(size)]
    rows += [(random.standard_normal(dims), int(random.integers(4))) for _ in range(alone)]
    return [(i, np.float32(v).tolist(), label) for i, (v, label) in enumerate(rows)]


def brute(rows, threshold=embedding.THRESHOLD):
    usable = [(i, np.array(v, float), label) for i, (_, v, label) in enumerate(rows)
              if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for n, (i, v, label) in enumerate(usable):
        for j, w, other in usable[n + 1:]:
            if label == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, (key, _, _) in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            for j in near[queue.pop()] - seen:
                seen.add(j)
                queue.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((key, len(near[i]), low, key == low))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("dims, chunk", [(64, 8192), (16, 40), (100, 64)])
def test_against_brute_force(spark, dims, chunk):
    rows = planted(dims, dims, [(150, 1), (60, 1), (30, 2), (5, 0), (2, 3)], 400, 0.15)
    rows += [(1000 + n, rows[n][1], rows[n][2]) for n in (0, 0, 0, 7, 300)] + [(2000, rows[0][1], 3)]
    got, want = result(embedding.near_duplicates(frame(spark, rows), chunk=chunk)), sorted(brute(rows), key=str)
    assert sum(r[1] for r in want) > 5_000
    # the index may miss pairs near the threshold; what it reports is never below it
    assert sum(r[1] for r in got) >= 0.995 * sum(r[1] for r in want)
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want))
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.99


def test_links_on_both_sides_of_the_threshold(spark):
    """Pairs of known cosine: all clear ones are found, none below the threshold."""
    random, rows = np.random.default_rng(5), []
    for n in range(600):
        v, w = np.linalg.qr(random.standard_normal((64, 2)))[0].T
        cosine = (0.9795, 0.9805, 0.985, 0.995)[n % 4]
        rows += [(2 * n, v.tolist(), 1), (2 * n + 1, (cosine * v + np.sqrt(1 - cosine ** 2) * w).tolist(), 1)]
    got = {r.vec_id: r for r in embedding.near_duplicates(frame(spark, rows)).collect()}
    found = [[got[2 * n].n_links for n in range(600) if n % 4 == kind] for kind in range(4)]
    assert sum(found[0]) == 0 and np.mean(found[1]) >= 0.95 and np.mean(found[2]) >= 0.97 and np.mean(found[3]) == 1
    assert all(got[2 * n + 1].component_id == 2 * n for n in range(600) if got[2 * n].n_links)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0], None), (4, [1.0, 2.0], 2), (5, [0.0, 0.0], 1),
            (6, None, 1), (7, [], 1), (8, [None, 1.0], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (None, [1.0, 2.0], 1),
            (None, [9.0, 0.0], 3), (None, [9.0, 0.0], 3), (13, [-1.0, -2.0], 1), (14, [1.0, 2.0, 0.0], 1), (15, [1e30, 2e30], 1), (16, [3.0], 5)]
    got = result(embedding.near_duplicates(frame(spark, rows)))
    assert got == sorted([(k, n, low, k == low or (k is None and low is None)) for k, n, low, _ in brute(rows)], key=str)
    assert embedding.near_duplicates(frame(spark, [])).isEmpty()


def test_tables_follow_the_number_of_vectors():
    for n in (0, 1, 50_000, 10 ** 7, 10 ** 12):
        width, tables, limit = embedding.plan_tables(n)
        miss = 1 - (1 - np.arccos(embedding.THRESHOLD) / np.pi) ** width
        assert 8 <= width <= 20 and miss ** tables <= 1 - embedding.RECALL and limit < width * tables / 2


def test_codes_are_balanced_and_keep_near_vectors_near():
    random = np.random.default_rng(1)
    v = embedding.unit(random.standard_normal((4000, 48)) @ np.diag(np.linspace(1, 3, 48)) + 0.5)
    mean, projection = embedding.quantiser(v, 60)
    code = (v - mean) @ projection > 0
    assert projection.shape == (48, 60) and np.abs(code.mean(0) - 0.5).max() < 0.05
    near = embedding.unit(v + 0.1 * random.standard_normal(v.shape) / np.sqrt(48))
    assert (((near - mean) @ projection > 0) != code).sum(1).mean() < 60 * 0.06
