"""Sharding by jump consistent hashing, in built-in expressions only.

A row's key is hashed to 64 bits and jumps from shard to shard until the next jump would leave the
shards. Only the key and the number of shards decide, no table of shards is kept, and a further shard
takes rows only into itself. Slots number the rows of a shard without gaps; they come from a sort of
the keys, which divides a large shard among many tasks, and texts are not moved.

A null key hashes like any other value, a null text has no bytes, repeated rows get slots of their own
in the same shard, an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.operators.scale import with_position
from presswork.session import materialise

# Multiplier of the published generator (Lamping and Veach).
MULTIPLIER = 2862933555777941757
_LOW = (1 << 22) - 1
_TOP = (1 << 20) - 1


def _next_state(k: Column) -> Column:
    """``k * MULTIPLIER + 1`` modulo 2^64. Three limbs keep each product within a long."""
    m = [MULTIPLIER & _LOW, MULTIPLIER >> 22 & _LOW, MULTIPLIER >> 44]
    k0, k1, k2 = k.bitwiseAND(_LOW), F.shiftrightunsigned(k, 22).bitwiseAND(_LOW), F.shiftrightunsigned(k, 44)
    r0 = k0 * F.lit(m[0]) + 1
    r1 = k0 * F.lit(m[1]) + k1 * F.lit(m[0]) + F.shiftright(r0, 22)
    r2 = k0 * F.lit(m[2]) + k1 * F.lit(m[1]) + k2 * F.lit(m[0]) + F.shiftright(r1, 22)
    return r0.bitwiseAND(_LOW).bitwiseOR(F.shiftleft(r1.bitwiseAND(_LOW), 22)).bitwiseOR(F.shiftleft(r2.bitwiseAND(_TOP), 44))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key. Each jump moves up at least one shard, so ``shards`` steps always suffice."""
    start = F.struct(key.alias("state"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("jump"))

    def step(s: Column, _: Column) -> Column:
        state = _next_state(s["state"])
        share = F.lit(float(1 << 31)) / (F.shiftrightunsigned(state, 33) + 1).cast("double")
        jump = F.floor((s["jump"] + 1).cast("double") * share)
        moved = F.struct(state.alias("state"), s["jump"].alias("shard"), jump.alias("jump"))
        return F.when(s["jump"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["shard"].cast("int"))


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def assign_shards(rows: DataFrame, shards: int, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """Add the shard of every row; a projection without shuffle."""
    return rows.withColumn(name, jump_hash(key_hash(F.col(key)), shards))


def number_slots(rows: DataFrame, order: list[str], shard: str = "shard", name: str = "slot") -> DataFrame:
    """Add a number from 0 within each shard, in the order of ``order``. Pass narrow rows that are stored."""
    numbered = with_position(rows, shard, *order, name=name)
    sizes = {r[0]: r[1] for r in rows.groupBy(shard).count().collect()}  # one number per shard
    first, at = [], 0
    for s in range(max(sizes, default=-1) + 1):
        first.append(at)
        at += sizes.get(s, 0)
    starts = F.array(*[F.lit(a).cast("long") for a in first or [0]])
    return numbered.withColumn(name, F.col(name) - F.get(starts, F.col(shard)))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (with one shard more)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(F.col(key), (F.octet_length(body).cast("long") + 1).alias("_size"), F.crc32(body).alias("_crc"))
    placed = narrow.select(
        F.col(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("key").alias("law"),
        jump_hash(key_hash(F.col(key)), shards).alias("shard"), jump_hash(key_hash(F.col(key)), shards + 1).alias("grown_shard"))
    slots = number_slots(materialise(placed, "shards"), [key, "text_crc32", "size"])
    return slots.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Write the rows as Parquet, one folder per shard; every task writes to the shards it meets, nothing is shuffled."""
    assign_shards(docs, shards, key, "shard").write.partitionBy("shard").parquet(path)
