"""Document fingerprints: quartile digests of hashed byte triplets.

Every triplet of bytes at distances 0, ``GAP`` and 2 ``GAP`` is hashed to one of ``BUCKETS`` buckets. Each
bucket is coded by the quartile its count falls into (two bits), and the digest also carries the
text's length on a logarithmic scale. The difference of two digests adds up the distances of their
codes and length classes, but is bounded by the level that independent codes reach by chance; the
likeness is 1 at no difference and 0 at the bound.

A null text counts as empty. A text of fewer than 2 ``GAP`` + 1 bytes has no triplets and is coded by all of
its bytes instead. Equal texts have equal digests. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from presswork.llm.common import append_from_text, shuffle_partitions, ship_code

BUCKETS = 256
GAP = 4
LENGTH_STEP = 1.25  # one length class per 25 % of length
CHANCE = 1.25  # mean difference of two independent quartile codes
LENGTH_WEIGHT = 4

_A, _B, _C, _MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x2C1B3C6D)
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)


def codes(data: bytes) -> np.ndarray:
    """Quartile code 0-3 of every bucket."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(a) > 2 * GAP:
        h = a[:-2 * GAP] * _A + a[GAP:-GAP] * _B + a[2 * GAP:] * _C
    else:
        h = a * _A + np.arange(len(a), dtype=np.uint32) * _B
    h ^= h >> np.uint32(15)
    h *= _MIX
    counts = np.bincount(h >> _SHIFT, minlength=BUCKETS)
    quartiles = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[
        [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return np.searchsorted(quartiles, counts).astype(np.uint8)


def digest(data: bytes) -> str:
    """Length class (two hex digits), then two bits a bucket."""
    length = min(int(np.log(len(data) + 1) / np.log(LENGTH_STEP)), 255)
    c = codes(data).reshape(-1, 4)
    return f"{length:02x}" + (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).tobytes().hex()


def _unpack(fingerprint: str) -> np.ndarray:
    b = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3]).astype(np.int16)


def difference(one: str, other: str) -> float:
    """Bounded difference of two digests: code distances and length classes, at most the chance level."""
    apart = int(np.abs(_unpack(one) - _unpack(other)).sum()) + LENGTH_WEIGHT * abs(int(one[:2], 16) - int(other[:2], 16))
    return min(float(apart), CHANCE * BUCKETS)


def likeness(one: str, other: str) -> float:
    return 1.0 - difference(one, other) / (CHANCE * BUCKETS)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", drop_text: bool = False) -> DataFrame:
    """Add the digest of every whole text. No shuffle."""
    return append_from_text(docs, text, f"`{name}` string", lambda: lambda ts: [[digest(t.encode()) for t in ts]], drop_text)


def with_next(docs: DataFrame, key: str, text: str, fields: str, make) -> DataFrame:
    """Rows (key, *fields) computed from each text and the text of the next key (after the last: the first).

    Keys are numbers; null keys come first and ties follow the order of their texts. Rows are dealt to
    key ranges by bounds from a quantile sketch, sorted there, and read in order; the first row of a
    range is sent to the range before as well. So each text is shuffled once, and a task holds two of
    them besides a batch. ``make()`` gives a function from two texts to the values of ``fields``.
    """
    ship_code(docs.sparkSession)
    narrow = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    n = shuffle_partitions(docs)
    quantiles = [i / n for i in range(1, n)]
    bounds = narrow.agg(F.percentile_approx(key, quantiles, 100 * n).alias("b")).first()["b"] if n > 1 else None
    cuts = np.array(sorted(set(bounds or [])))

    def range_numbers(known: pd.Series, keys: pd.Series) -> np.ndarray:
        return np.where(known, np.searchsorted(cuts, keys.to_numpy()), 0)

    @F.pandas_udf("int")
    def range_of(known: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(range_numbers(known, keys))

    keyed = narrow.select(key, "_text", F.col(key).isNotNull().alias("_known"), F.coalesce(key, F.lit(0)).alias("_sort"))
    # one row for each range that has rows: its first key, unknown keys first
    firsts = keyed.groupBy(range_of("_known", "_sort").alias("r")).agg(F.min(F.struct("_known", "_sort")).alias("first"))
    order = sorted((r["r"], r["first"]["_known"], r["first"]["_sort"]) for r in firsts.collect())
    # the first rows of a range also go to the range before, those of the first range to the last
    before, first_known, first_key = np.full(n + 1, -1), np.zeros(n + 1, bool), [0] * (n + 1)
    for i, (r, known, first) in enumerate(order):
        before[r], first_known[r], first_key[r] = order[i - 1][0], known, first
    first_keys = np.array(first_key)

    @F.pandas_udf("int")
    def range_before(known: pd.Series, keys: pd.Series) -> pd.Series:
        r = range_numbers(known, keys)
        is_first = (first_known[r] == known) & (~known | (first_keys[r] == keys.to_numpy()))
        return pd.Series(np.where(is_first, before[r], -1))

    places = F.array(F.struct(range_of("_known", "_sort").alias("r"), F.lit(False).alias("more")),
                     F.struct(range_before("_known", "_sort").alias("r"), F.lit(True).alias("more")))
    dealt = keyed.select(F.col(key).alias("_key"), "_text", F.explode(F.filter(places, lambda x: x["r"] >= 0)).alias("_to"))
    sorted_rows = dealt.select("_key", "_text", "_to.*").repartitionById(n, "r").sortWithinPartitions("r", "more", "_key", "_text")
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = make()
        held = None  # (range, key, text) that waits for its next text
        for batch in batches:
            out: list[tuple] = []
            for k, t, r, more in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held is not None and held[0] == r:
                    out.append((held[1], *work(held[2], t)))
                held = None if more else (r, k, t)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return sorted_rows.mapInArrow(run, schema)


def compare_with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text, of the text whose last quarter is replaced from the next text, and their likeness."""

    def make():
        known: dict[str, tuple[str, str]] = {"text": ("", "")}

        def own(t: str) -> str:
            # the next text of one row is the text of the row after it
            if known["text"][0] != t or not known["text"][1]:
                known["text"] = (t, digest(t.encode()))
            return known["text"][1]

        def work(t: str, after: str) -> tuple:
            n = len(t)
            edited = (t[:n - n // 4] + after[:n // 4]).encode()
            fp, fp_edited, fp_next = own(t), digest(edited), own(after)
            return n, hashlib.sha256(edited).hexdigest(), fp, fp_edited, likeness(fp, fp_edited), likeness(fp, fp_next)

        return work

    return with_next(docs, key, text, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                     "near_edited double, near_next double", make)
