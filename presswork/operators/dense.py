"""Dense document vectors: a truncated singular value decomposition of stored sparse features.

A random range finder with power steps. Each step is one job over the stored rows: a task multiplies its rows, entry by entry, with
the present basis and returns one narrow matrix (buckets by columns), which is summed block by block. The driver holds
such matrices only; their size is fixed by buckets and width, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_ENTRIES = 1 << 17  # entries multiplied at a time, so that a task holds this many rows of the basis at most
BLOCK_BUCKETS = 256  # buckets of a summed matrix in one row


@dataclass
class Projection:
    """Orthonormal ``basis`` (buckets by width) and the singular value of each of its columns, highest first."""

    basis: np.ndarray
    singular: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per bucket; the singular values have bucket -1."""
        rows = [(-1, self.singular.tolist()), *((i, row.tolist()) for i, row in enumerate(self.basis))]
        spark.createDataFrame(rows, "bucket int, loadings array<double>").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Projection:
        rows = spark.read.schema("bucket int, loadings array<double>").parquet(path).orderBy("bucket").collect()
        return Projection(np.array([r["loadings"] for r in rows[1:]]), np.array(rows[0]["loadings"]))


def _entries(vector: str) -> list[Column]:
    """Indices and values of a stored vector; a dense one has no indices."""
    values = F.col(f"{vector}.values")
    every = F.sequence(F.lit(0), F.size(values) - 1)
    return [F.coalesce(F.col(f"{vector}.indices"), every).alias("at"), values.alias("value")]


def _chunks(indices: pa.Array, values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
    """Row of each entry (from 0 in its chunk), index, value, and the rows of the chunk; a row is never divided."""
    lengths = indices.value_lengths().fill_null(0).to_numpy()
    at, value = indices.flatten().to_numpy(), values.flatten().to_numpy()
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        begin = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + CHUNK_ENTRIES, "right")))
        rows = np.repeat(np.arange(last - first), lengths[first:last])
        yield rows, at[begin:ends[last - 1]], value[begin:ends[last - 1]], slice(first, last)
        first = last


def _times(rows: np.ndarray, at: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """The chunk's rows times ``basis``."""
    return np.stack([np.bincount(rows, value * basis[at, j], n) for j in range(basis.shape[1])], axis=1)


def _summed(parts: DataFrame, buckets: int, columns: int) -> np.ndarray:
    """Sum of the tasks' matrices, combined block by block before and after the shuffle."""
    total = Summarizer.metrics("sum").summary(array_to_vector("part"))
    summed = np.zeros((buckets, columns))
    for r in parts.groupBy("block").agg(total.alias("_s")).select("block", vector_to_array("_s.sum").alias("total")).collect():
        block = np.array(r["total"]).reshape(-1, columns)
        summed[r["block"] * BLOCK_BUCKETS:r["block"] * BLOCK_BUCKETS + len(block)] = block
    return summed


def _step(stored: DataFrame, vector: str, basis: np.ndarray, gram: bool) -> np.ndarray:
    """One pass over the rows A: ``A' (A basis)``, or with ``gram`` only ``(A basis)' (A basis)``."""
    buckets, columns = basis.shape

    def sums(batches):
        total = np.zeros((columns if gram else buckets, columns))
        for batch in batches:
            for rows, at, value, span in _chunks(batch.column("at"), batch.column("value")):
                image = _times(rows, at, value, span.stop - span.start, basis)
                if gram:
                    total += image.T @ image
                else:
                    for j in range(columns):
                        total[:, j] += np.bincount(at, value * image[rows, j], buckets)
        blocks = [total[i:i + BLOCK_BUCKETS].ravel().tolist() for i in range(0, len(total), BLOCK_BUCKETS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.list_(pa.float64()))], ["block", "part"])

    rows = stored.filter(F.col(vector).isNotNull()).select(*_entries(vector))
    return _summed(rows.mapInArrow(sums, "block int, part array<double>"), columns if gram else buckets, columns)


def fit_projection(stored: DataFrame, vector: str, buckets: int, width: int, spare: int = 8, power_steps: int = 3, seed: int = 1) -> Projection:
    """The ``width`` leading right singular vectors of the rows of a stored sparse column (``features.store_sparse``).

    ``spare`` more columns take part in the search, and each power step is one more pass, which brings the basis closer to the
    exact one. Signs are fixed: a column's entry of largest size is positive. Directions that the rows do not have, as in a table
    without rows, have the singular value 0 and are no less orthonormal. The basis in a task takes ``8 * buckets * (width + spare)`` bytes.
    """
    columns = min(width + spare, buckets)
    if width > columns:
        raise ValueError(f"{buckets} buckets have no {width} directions")
    start = np.random.default_rng(seed).normal(size=(buckets, columns))
    basis = np.linalg.qr(start)[0]
    for _ in range(1 + power_steps):
        image = _step(stored, vector, basis, gram=False)
        # the start fills up what the rows leave open; it is too small to turn any other direction
        scale = np.abs(image).max() or 1.0
        basis = np.linalg.qr(image / scale + 1e-13 * start)[0]
    squares, turn = np.linalg.eigh(_step(stored, vector, basis, gram=True))
    order = np.argsort(squares)[::-1][:width]
    basis = basis @ turn[:, order]
    basis *= np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(width)])
    return Projection(basis, np.sqrt(np.maximum(squares[order], 0.0)))


def dense_vector(vector: str, projection: Projection) -> Column:
    """Array of ``width`` numbers for a stored sparse column, row by row without a shuffle. Null stays null, an empty row is all zeros."""
    basis = projection.basis

    @F.arrow_udf("array<double>")
    def multiply(indices: pa.Array, values: pa.Array) -> pa.Array:
        out = np.zeros((len(indices), basis.shape[1]))
        for rows, at, value, span in _chunks(indices, values):
            out[span] = _times(rows, at, value, span.stop - span.start, basis)
        present = indices.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(np.where(present, basis.shape[1], 0))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~present, False)), pa.array(out[present].ravel()))

    return multiply(*_entries(vector))


def with_dense(stored: DataFrame, vector: str, projection: Projection, out: str = "dense") -> DataFrame:
    """Add the dense vector, and ``kept``: the share of the row's squared length that it holds (null for a row of zeros)."""
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    return stored.withColumn(out, dense_vector(vector, projection)).withColumn(
        "kept", F.try_divide(square(F.col(out)), square(F.col(f"{vector}.values"))))
