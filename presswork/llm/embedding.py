"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the vectors.

Codes. A rotation is learned on a bounded sample (``SAMPLE`` vectors; every vector is indexed): the centred
unit vectors are projected on their principal axes, and rotation and signs are fitted to each other in
turns, so that the signs of the rotated vectors are balanced codes with little loss. Codes longer than the
vectors take several rotations, fitted from different beginnings.

Tables. A code is cut into substrings, one table each; vectors that share a substring in some table, and
whose whole codes differ in few bits, are candidates. The substrings' width follows the number of vectors, so
a bucket does not grow with the corpus, and there are so many tables that a pair right at the threshold
shares a substring with a chance of ``RECALL``. Buckets come sorted, many to a task; one beyond
``CHUNK`` members is cut into chunks that meet pairwise in separate tasks. A task hands on rows that connect its
candidates, never their pairs.

Rerank. What candidates connect is compared again with the original vectors: every pair of a
candidate component with the same label has its cosine taken in double precision, component by component,
large ones chunk against chunk. Only the number of links and connecting rows come out, and components of
true links are found in rounds of stored tables.

Equal vectors of one label are compared once and counted as often as they occur; they are told by 128 bits
of hash, their length and label. Rows with a null label, and vectors that are null, empty or zero or hold a null or
a component that is not finite, link with nothing; nor do vectors of different lengths. Null ids
never name a component unless all its ids are null. Repeated ids are vectors of their own. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from presswork.llm.common import ship_code
from presswork.llm.simhash import components
from presswork.session import materialise

THRESHOLD = 0.98
RECALL = 0.98
SAMPLE = 20_000
ROUNDS = 30
CHUNK = 8192
BUCKET = 64  # vectors aimed at in a bucket
_DENSE = 48  # larger runs are compared as matrices


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """Substring width, number of tables, and the largest distance of whole codes."""
    width = min(20, max(8, math.ceil(math.log2(max(n, 1) / BUCKET))))
    flip = math.acos(threshold) / math.pi  # chance that a hyperplane parts a pair at the threshold
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - flip) ** width))
    bits = width * tables
    return width, tables, math.ceil(bits * flip + 3 * math.sqrt(bits * flip * (1 - flip)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def quantiser(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection learned from unit vectors; a vector's code is ``(v - mean) @ projection > 0``."""
    mean = sample.mean(0)
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    random = np.random.default_rng(seed)
    found: list[np.ndarray] = []
    while sum(p.shape[1] for p in found) < bits:
        kept = axes[:, :min(64, axes.shape[1])]
        projected = centred @ kept
        rotation = np.linalg.qr(random.standard_normal((kept.shape[1], kept.shape[1])))[0]
        for _ in range(rounds):
            signs = np.where(projected @ rotation > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ projected)
            rotation = right.T @ left.T
        found.append(kept @ rotation)
    return mean, np.concatenate(found, 1)[:, :bits]


def plain_quantiser(length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For vectors of an uncommon length: rotations that are drawn, not learned."""
    random = np.random.default_rng(length)
    drawn = [np.linalg.qr(random.standard_normal((length, length)))[0] for _ in range(-(-bits // length))]
    return np.zeros(length), np.concatenate(drawn, 1)[:, :bits]


def substrings(codes: np.ndarray, width: int) -> np.ndarray:
    """Rows of bits as rows of numbers, one for each table."""
    return codes.reshape(len(codes), -1, width) @ (1 << np.arange(width))


def connect(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n members the smallest label that the links (a, b) reach."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_codes(run: np.ndarray, other: np.ndarray, limit: int) -> np.ndarray:
    """Matrix: whether codes differ in at most ``limit`` bits. Codes are rows of substrings."""
    apart = np.zeros((len(run), len(other)), np.uint8)
    for column in range(run.shape[1]):
        apart += np.bitwise_count(run[:, column][:, None] ^ other[:, column][None, :])
    return apart <= limit


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with the same value in ``column``, from a sorted stream; none is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy()
        new = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(column)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            cut = int(new[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)].tolist()
    return list(zip(edges, edges[1:]))


def matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """Rows of equally long arrays."""
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype).reshape(len(column), -1)


def in_chunks(rows: DataFrame, group: list[str], chunk: Column, spread: Column) -> DataFrame:
    """Rows with ``_run`` (a 64-bit name of group and chunk pair) and ``_side``, sorted inside their partition by it.

    A group with more rows than ``chunk`` is dealt to chunks; the rows of a chunk meet those of its own
    chunk (side 0 only) and those of every other one.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_k", F.ceil(F.col("_n") / chunk).cast("int"))
    kept = rows.join(sizes.select(*group, "_k"), group).withColumn("_own", F.pmod(spread, F.col("_k")).cast("int"))
    met = kept.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    pair = [F.least("_own", "_other"), F.greatest("_own", "_other")]
    named = met.withColumn("_side", (F.col("_own") > F.col("_other")).cast("int")).withColumn("_run", F.xxhash64(*group, *pair))
    # the group's own columns follow the name, so equal names of unlike groups stay apart
    named = named.withColumn("_group", F.xxhash64(F.lit(7), *group, *pair))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return named.drop("_k", "_own", "_other").repartition(parts, "_run").sortWithinPartitions("_run", "_group", "_side")


def _stars(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    moved = label != np.arange(len(label))
    return ids[moved], ids[label[moved]]


def candidate_links(indexed: DataFrame, limit: int, chunk: int = CHUNK) -> DataFrame:
    """Rows (a, b) that connect all vectors that share a substring and whose codes differ in at most ``limit`` bits.

    ``indexed`` has ``id``, ``label``, ``length`` and ``code``, an array with one substring for each table.
    """
    dealt = indexed.select("id", "label", "length", "code", F.posexplode("code").alias("table", "part"))
    met = in_chunks(dealt, ["label", "length", "table", "part"], F.lit(chunk), F.xxhash64("id")).select("_run", "_group", "_side", "id", "code")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "_run"):
            ids, code, side, group = table["id"].to_numpy(), matrix(table["code"], np.int32), table["_side"].to_numpy(), table["_group"].to_numpy()
            label = np.arange(len(ids))
            bounds = run_bounds(group)
            # short runs all at once: each row against the one so many places on
            short = np.zeros(len(ids), bool)
            for a, b in bounds:
                short[a:b] = b - a <= _DENSE
            for step in range(1, min(_DENSE, max((b - a for a, b in bounds if b - a <= _DENSE), default=1))):
                at = np.flatnonzero(short[:-step] & (group[:-step] == group[step:]) & ((side[:-step] != side[step:]) | (side[step:] == 0)))
                near = np.bitwise_count(code[at] ^ code[at + step]).sum(1) <= limit
                label = connect(len(ids), at[near], at[near] + step, label)
            for a, b in bounds:
                if b - a <= _DENSE:
                    continue
                middle = a + int(np.searchsorted(side[a:b], 1))
                first, past = (a, b) if middle == b else (middle, b)  # own chunk, or the other one
                for at in range(a, middle, 256):
                    row, column = np.nonzero(near_codes(code[at:min(at + 256, middle)], code[first:past], limit))
                    label = connect(len(ids), row + at, column + first, label)
            a, b = _stars(ids, label)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long").distinct()


def verified(members: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """Rows (id, links, low) for members of the same ``root``: how many other vectors are linked, copies counted, and
    a smaller id that links reach, or the id itself. One row per chunk pair that an id meets.

    ``members`` has ``id``, ``root``, ``copies`` and ``vector``.
    """
    met = in_chunks(members, ["root"], F.lit(chunk), F.xxhash64("id")).select("_run", "_group", "_side", "id", "copies", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "_run"):
            group = table["_group"].to_numpy()
            for a, b in run_bounds(group):
                part = table.slice(a, b - a)
                ids, copies, side = (part[c].to_numpy() for c in ("id", "copies", "_side"))
                vectors = unit(matrix(part["vector"], np.float64))
                middle = int(np.searchsorted(side, 1))
                label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
                cross = middle < len(ids)
                first = middle if cross else 0
                for at in range(0, middle, 256):
                    past = min(at + 256, middle)
                    near = vectors[at:past] @ vectors[first:].T >= threshold
                    if not cross:
                        near[np.arange(past - at), np.arange(at, past)] = False
                    links[at:past] += near @ copies[first:]
                    if cross:
                        links[first:] += copies[at:past] @ near
                    row, column = np.nonzero(near)
                    label = connect(len(ids), row + at, column + first, label)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[label])], names=["id", "links", "low"])

    return met.mapInArrow(compare, "id long, links long, low long")


def _coder(width: int, tables: int, learned: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[np.ndarray], np.ndarray]:
    def code(vectors: np.ndarray) -> np.ndarray:
        length = vectors.shape[1]
        if length not in learned:
            learned[length] = plain_quantiser(length, width * tables)
        mean, projection = learned[length]
        return substrings((unit(vectors) - mean) @ projection > 0, width)

    return code


def with_codes(vectors: DataFrame, key: str, vector: str, label: str, threshold: float = THRESHOLD, recall: float = RECALL,
               sample: int = SAMPLE) -> tuple[DataFrame, int]:
    """Stored rows (key, label, length, vector, code, h1, h2, id), and the distance limit of codes. Rows that can link with
    nothing have a null code."""
    spark = vectors.sparkSession
    ship_code(spark)
    v = F.col(vector)
    usable = F.col(label).isNotNull() & v.isNotNull() & F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), v.alias("vector"), F.when(usable, F.size(v)).alias("length"))
    # lengths are few; the most frequent one is learned
    common = rows.where("length > 0").groupBy("length").count().orderBy(F.desc("count"), "length").limit(1).collect()
    total = rows.where("length > 0").count() if common else 0
    width, tables, limit = plan_tables(total, threshold, recall)
    learned = {}
    if common:
        length, n = common[0]
        share = min(1.0, sample / n)
        few = rows.where(F.col("length") == length).where(
            F.pmod(F.xxhash64("key", "vector"), F.lit(1 << 40)) < int(share * (1 << 40))).select("vector").limit(2 * sample).toArrow()
        if few.num_rows:
            learned[length] = quantiser(unit(matrix(few["vector"], np.float64)), width * tables)
    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _coder(width, tables, dict(learned))
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            out: list[np.ndarray | None] = [None] * batch.num_rows
            for length in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == length)
                found = code(matrix(pa.chunked_array([batch.column("vector").take(pa.array(at))]), np.float64)).astype(np.int32)
                for i, c in zip(at.tolist(), found):
                    out[i] = c
            kept = [batch.column(i).cast(arrow.field(i).type) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, arrow.field("code").type)], schema=arrow)

    made = rows.mapInArrow(encode, schema)
    hashed = made.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    return materialise(hashed.withColumn("id", F.monotonically_increasing_id()), "codes"), limit


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """Per row: key, ``n_links`` (other vectors of the label at or above the threshold), ``component_id`` (the smallest
    key that links reach) and ``kept`` (whether that is its own)."""
    stored, limit = with_codes(vectors, key, vector, label, threshold, recall, sample)
    same = ["label", "length", "h1", "h2"]
    usable = stored.where(F.col("code").isNotNull())
    distinct = materialise(usable.groupBy(*same).agg(
        F.min("id").alias("id"), F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct")
    code = stored.select("id", "code")
    indexed = distinct.select("id", "label", "length").join(code, "id")
    roots = materialise(components(candidate_links(indexed, limit, chunk)).select(F.col("node").alias("id"), "root"), "candidates")
    members = stored.select("id", "vector").join(roots, "id").join(distinct.select("id", "copies"), "id")
    checked = materialise(verified(members, threshold, chunk), "links")
    true_roots = components(checked.select(F.col("id").alias("a"), F.col("low").alias("b")))
    counts = checked.groupBy("id").agg(F.sum("links").alias("links"))
    placed = distinct.join(counts, "id", "left").join(true_roots.withColumnRenamed("node", "id"), "id", "left").select(
        *same, "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    placed = materialise(placed, "placed")
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    found = placed.join(names, "root").select(*same, "n_links", "component_id")
    own = stored.select(F.col("key").alias(key), *same)
    component = F.when(F.col("n_links").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return own.join(found, same, "left").select(
        key, F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.equal_null(F.col(key), component).alias("kept"))
