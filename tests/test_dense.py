"""Dense vectors against an exact decomposition of the same rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.operators import dense, features
from presswork.plans import QUERIES

BUCKETS, WIDTH = 40, 5
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", VectorUDT())])


@pytest.fixture(scope="module")
def matrix():
    """300 sparse rows near five directions, with an empty row and one row that makes up a third of the table."""
    rng = np.random.default_rng(11)
    mixed = rng.normal(size=(300, WIDTH)) @ (np.array([9, 7, 5, 4, 3])[:, None] * rng.normal(size=(WIDTH, BUCKETS)))
    full = np.where(rng.random((300, BUCKETS)) < 0.9, mixed + rng.normal(0, 0.3, (300, BUCKETS)), 0.0)
    full[7], full[200:] = 0.0, full[200]
    return full


@pytest.fixture(scope="module")
def stored(spark, matrix):
    rows = [(i, Vectors.sparse(BUCKETS, np.flatnonzero(r).tolist(), r[r != 0].tolist())) for i, r in enumerate(matrix)]
    rows[3] = (3, Vectors.dense(matrix[3].tolist()))
    return features.store_sparse(spark.createDataFrame([*rows, (999, None)], SCHEMA).repartition(7), "v")


@pytest.mark.parametrize("entries, buckets", [(dense.CHUNK_ENTRIES, dense.BLOCK_BUCKETS), (50, 16)])
def test_basis_and_vectors_equal_the_exact_ones(stored, matrix, monkeypatch, entries, buckets):
    monkeypatch.setattr(dense, "CHUNK_ENTRIES", entries)
    monkeypatch.setattr(dense, "BLOCK_BUCKETS", buckets)
    got = dense.fit_projection(stored, "v", BUCKETS, WIDTH, power_steps=6)
    _, singular, right = np.linalg.svd(matrix)
    assert np.allclose(got.basis.T @ got.basis, np.eye(WIDTH), atol=1e-10)
    assert np.allclose(got.singular, singular[:WIDTH], rtol=1e-6)
    assert np.allclose(np.abs((got.basis * right[:WIDTH].T).sum(0)), 1, atol=1e-5)
    assert (got.basis.max(0) == np.abs(got.basis).max(0)).all()
    rows = {r.id: r for r in dense.with_dense(stored, "v", got).collect()}
    assert rows[999].dense is None and rows[999].kept is None
    assert rows[7].dense == [0.0] * WIDTH and rows[7].kept is None
    vectors = np.array([rows[i].dense for i in range(300)])
    assert np.allclose(vectors, matrix @ got.basis, atol=1e-9)
    # what is left out is no more than the best possible
    left = (matrix ** 2).sum() - (vectors ** 2).sum()
    assert left == pytest.approx((singular[WIDTH:] ** 2).sum(), rel=1e-6)
    assert all(0 <= rows[i].kept <= 1 + 1e-12 for i in range(300) if i != 7)


def test_rows_without_so_many_directions(spark):
    rows = [(i, SparseVector(6, [1, 4], [1.0 + i % 3, 2.0])) for i in range(9)]
    flat = features.store_sparse(spark.createDataFrame(rows, SCHEMA), "v")
    for table, rank in ((flat, 2), (flat.limit(0), 0)):
        got = dense.fit_projection(table, "v", 6, 4)
        assert np.allclose(got.basis.T @ got.basis, np.eye(4), atol=1e-8)
        assert (got.singular > 1e-6).sum() == rank
    with pytest.raises(ValueError):
        dense.fit_projection(flat, "v", 6, 7)


def test_saved_projection_is_the_same(spark, stored, tmp_path):
    got = dense.fit_projection(stored, "v", BUCKETS, WIDTH)
    got.save(spark, str(tmp_path / "p"))
    again = dense.Projection.load(spark, str(tmp_path / "p"))
    assert (again.basis == got.basis).all() and (again.singular == got.singular).all()


def test_vectors_are_made_without_a_shuffle(stored):
    projection = dense.Projection(np.eye(BUCKETS, WIDTH), np.ones(WIDTH))
    plan = dense.with_dense(stored, "v", projection)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_query_keeps_most_of_each_document(spark):
    rows = QUERIES["dense_features"](spark, "/root/testdata/sf0.001")
    seen = rows.agg(F.count("*").alias("n"), F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most"),
                    F.avg("kept").alias("kept")).first()
    assert seen.n == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert seen.least == seen.most == 32 and seen.kept > 0.4
