"""Building blocks that keep exact results without a hot task: global positions,
prefix aggregates and joins to lookup tables of checked size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.session import materialise

# monotonically_increasing_id: partition number in the upper bits, row number in the lower 33.
ROW_BITS = 33
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
FILTER_BITS = 1 << 29  # 64 MB, whatever the number of keys


def _marked(df: DataFrame, order: tuple) -> DataFrame:
    """Range-sorted copy of ``df`` on disk, each row marked with ``(_part, _mark)``.

    A range sort on a unique key splits any hot group over many tasks.
    """
    ordered = df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id())
    return materialise(ordered, "sorted").withColumn("_part", F.shiftright("_mark", ROW_BITS))


def with_position(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """Add the dense 0-based position of every row in the given total order.

    Same numbers as ``row_number() - 1`` over one global window, but no task ever sees
    more than one sort partition. Pass only the columns that are needed.
    """
    marked = _marked(df, order)
    # one number per sort partition comes to the driver, however many rows there are
    sizes = {r["_part"]: r["n"] for r in marked.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    start = F.get(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>"), F.col("_part").cast("int"))
    row = F.col("_mark").bitwiseAND((1 << ROW_BITS) - 1)
    return marked.withColumn(name, start + row).drop("_part", "_mark")


def prefix_scan(df: DataFrame, order: list, sums: dict[str, str] | None = None,
                maxima: dict[str, str] | None = None) -> DataFrame:
    """Running sums and maxima in a total order; ``{output: input}`` column names.

    Runs inside each sort partition and adds what the earlier partitions carry over.
    """
    spec = [(out, col, F.sum, lambda a, b: a + b, F.lit(0)) for out, col in (sums or {}).items()]
    spec += [(out, col, F.max, lambda a, b: F.greatest(a, b), F.lit(None)) for out, col in (maxima or {}).items()]
    marked = _marked(df, tuple(order))
    partial = marked.groupBy("_part").agg(*[fn(col).alias(f"_c_{out}") for out, col, fn, _, _ in spec])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = partial.select(
        "_part", *[F.coalesce(fn(f"_c_{out}").over(before), empty).alias(f"_c_{out}") for out, _, fn, _, empty in spec]
    )
    inside = Window.partitionBy("_part").orderBy("_mark").rowsBetween(Window.unboundedPreceding, 0)
    joined = marked.join(F.broadcast(carry), "_part")
    for out, col, fn, combine, _ in spec:
        joined = joined.withColumn(out, combine(fn(col).over(inside), F.col(f"_c_{out}")))
    return joined.drop("_part", "_mark", *[f"_c_{out}" for out, *_ in spec])


def _row_bytes(df: DataFrame) -> Column:
    def width(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.octet_length(c)
        if isinstance(field.dataType, T.ArrayType):
            return F.size(c) * 8
        return F.lit(8)

    return reduce(lambda a, b: a + b, [F.coalesce(width(f), F.lit(0)).cast("long") for f in df.schema.fields])


def fits_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a table (one small aggregate) before it may be broadcast."""
    seen = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_row_bytes(table)), F.lit(0)).alias("b")).first()
    return seen["n"] <= max_rows and seen["b"] <= max_bytes


def lookup_join(facts: DataFrame, table: DataFrame, keys: list[str], spread: list[str], how: str = "left",
                max_rows: int = BROADCAST_ROWS, weight: str | None = None, fits: bool | None = None) -> DataFrame:
    """Join ``facts`` to a lookup table with unique ``keys``; ``how`` is left or inner.

    A table of checked size is broadcast; ``fits`` passes on an earlier check of the same table. For a
    larger one ``weight`` names its column of occurrence counts (not part of the result): the rows
    of the highest counts, which carry most facts, are broadcast, and only facts not found among
    them are shuffled against the rest. Without counts the table is copied to as many salts as
    there are shuffle partitions. All ways give the same rows.
    """
    values = table.drop(weight) if weight else table
    if fits_broadcast(table, max_rows) if fits is None else fits:
        return facts.join(F.broadcast(values), keys, how)
    if weight:
        return _head_tail_join(facts, table, keys, how, max_rows, weight)
    salts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted_table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_facts.join(salted_table, [*keys, "_salt"], how).drop("_salt")


def count_cut(table: DataFrame, weight: str, max_rows: int = BROADCAST_ROWS) -> int | None:
    """Smallest count that is reached by at most ``max_rows`` rows; none if there is no such count."""
    # few distinct counts come first, so a count histogram cut off at max_rows entries is enough
    top = table.groupBy(weight).agg(F.count(F.lit(1)).alias("_rows")).orderBy(F.desc(weight)).limit(max_rows)
    upto = Window.orderBy(F.desc(weight)).rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("_upto", F.sum("_rows").over(upto)).filter(F.col("_upto") <= max_rows).agg(F.min(weight)).first()[0]


def join_own(df: DataFrame, key: str, own: DataFrame) -> DataFrame:
    """Rows with the columns of ``own``, one row per key there; a null key finds its own."""
    return df.join(own.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def _head_tail_join(facts: DataFrame, table: DataFrame, keys: list[str], how: str, max_rows: int, weight: str) -> DataFrame:
    cut = count_cut(table, weight, max_rows)
    in_head = F.col(weight) >= cut if cut is not None else F.lit(False)
    columns = [c for c in table.columns if c not in (*keys, weight)]
    head = table.filter(in_head).select(*keys, F.struct(F.lit(True).alias("_hit"), *columns).alias("_found"))
    tail = table.filter(~in_head).select(*keys, F.struct(F.lit(True).alias("_hit"), *columns).alias("_found"))
    tried = facts.join(F.broadcast(head), keys, "left")
    found = tried.filter(F.col("_found").isNotNull())
    rest = tried.filter(F.col("_found").isNull()).drop("_found").join(tail.hint("merge"), keys, how)
    return found.unionByName(rest).select(*keys, *[c for c in facts.columns if c not in keys], *[F.col(f"_found.{c}").alias(c) for c in columns])



def hash_bits(keys: DataFrame, column: str, max_bits: int = FILTER_BITS) -> np.ndarray:
    """Bits set at the places of integer ``column``, modulo their number: 16 bits a key, ``max_bits`` at most.

    Stretches of bits are made where the keys are grouped, so the driver gets no keys, only bits.
    """
    n = keys.count()
    bits = min(max_bits, 1 << max(16, (16 * n - 1).bit_length()))
    stretch = max(bits >> 6, 1 << 10)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(stretch, dtype=np.uint8)
        marks[rows["_slot"].to_numpy() % stretch] = 1
        return pd.DataFrame({"part": rows["_part"].iloc[:1], "marks": [np.packbits(marks, bitorder="little").tobytes()]})

    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    placed = keys.select(slot.cast("int").alias("_slot")).withColumn("_part", F.floor(F.col("_slot") / stretch).cast("int"))
    filled = np.zeros(bits // 8, dtype=np.uint8)
    for r in placed.distinct().groupBy("_part").applyInPandas(fill, "part int, marks binary").toLocalIterator():
        filled[r["part"] * stretch // 8:(r["part"] + 1) * stretch // 8] = np.frombuffer(r["marks"], dtype=np.uint8)
    return filled


def among(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of integer hashes are set in what ``hash_bits`` gave."""
    slot = hashes & hashes.dtype.type(marks.size * 8 - 1)
    return ((marks[slot >> hashes.dtype.type(3)] >> (slot & hashes.dtype.type(7)).astype(np.uint8)) & 1).astype(bool)


def hash_filter(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """Whether a hash may be among those of ``keys``: true for all that are, and for few others. Bounded in memory, so what
    it lets through is to be checked or counted exactly."""
    share = keys.sparkSession.sparkContext.broadcast(hash_bits(keys, column))

    @F.arrow_udf("boolean")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for hashes in batches:
            found = among(share.value, hashes.fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.array(found, mask=hashes.is_null().to_numpy(zero_copy_only=False))

    return lambda hashed: F.coalesce(listed(hashed), F.lit(False))
