"""URL filters: rules on host and path, then a blocklist held as a sorted array of digests.

The blocklist's entries (hosts, or hosts with paths) are hashed to 64 bits with xxhash and sorted by
Spark. The sorted digests, the places of the strings and the strings themselves make one file, which goes
to every executor once; all workers of an executor map that file, probe the digests with a vectorised
binary search, and confirm a hit against the stored full string, so a collision never blocks. A URL is
probed by its host, every parent domain of it, and host and path together.

A file has about ``BLOCK_BYTES`` at most, as the size of the list is measured and its digests cut into ranges that
hold equal shares. Each block is one pass, stored before the next, over narrow rows (key, host, path); a list of
ordinary size is one block and one pass without shuffle. The list of the caller is used; ``BLOCKED_HOSTS`` is a short
default.

A null URL or one without "://" has an empty host and path; it fits no rule and no entry and is
allowed. Very long URLs are judged whole. Repeated rows are judged alike, and repeated and null entries count for
nothing; an empty list blocks nothing, an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import ship_code
from presswork.session import materialise

RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org"))
BLOCK_BYTES = 64 << 20
SEED = 42  # of Spark's xxhash64


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    """Whether a rule ``host/path`` fits its host or a subdomain and the beginning of the path."""
    name, _, rest = rule.partition("/")
    return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    made = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        made = F.when(fits(rule, host, path), hit).otherwise(made)
    return made


def digest_of(entry: bytes) -> int:
    """The hash that Spark gives the same string."""
    return xxhash.xxh64_intdigest(entry, SEED)


def file_of(entries: pa.Table) -> bytes:
    """Digests, ends of the strings and the strings, from rows (digest, entry) sorted by digest."""
    table = entries.combine_chunks()
    strings = table["entry"].cast(pa.large_binary()).combine_chunks()
    digests = table["digest"].to_numpy().astype(np.int64)
    ends = pc.binary_length(strings).to_numpy().astype(np.int64).cumsum() if len(digests) else np.zeros(0, np.int64)
    return digests.tobytes() + ends.tobytes() + b"".join(strings.to_pylist()) + b"\0"


class DigestArray:
    """A mapped file of ``size`` entries."""

    def __init__(self, path: str, size: int):
        self.size = size
        self.digests = np.memmap(path, np.int64, "r", 0, (size,)) if size else np.zeros(0, np.int64)
        self.ends = np.memmap(path, np.int64, "r", 8 * size, (size,)) if size else np.zeros(0, np.int64)
        self.strings = np.memmap(path, np.uint8, "r", 16 * size)

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i - 1]) if i else 0:int(self.ends[i])].tobytes()

    def contains(self, probes: list[str]) -> np.ndarray:
        raw = [p.encode() for p in probes]
        found = np.zeros(len(raw), bool)
        if not self.size:
            return found
        digests = np.fromiter(map(digest_of, raw), np.uint64, len(raw)).view(np.int64)
        at = np.searchsorted(self.digests, digests)
        near = np.flatnonzero(self.digests[np.minimum(at, self.size - 1)] == digests)
        for i in near.tolist():
            j = int(at[i])
            while j < self.size and self.digests[j] == digests[i] and not found[i]:  # entries that share a digest
                found[i] = self.string(j) == raw[i]
                j += 1
        return found


def probes_of(host: str, path: str) -> list[str]:
    """Host, its parent domains, and host with path."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] + [host + path]


def list_blocks(entries: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[bytes, int]]:
    """(file, entries in it) of the one-column table's distinct entries, a range of digests at a time."""
    entry = F.col(entries.columns[0])
    listed = entries.where(entry.isNotNull()).select(entry.alias("entry")).distinct().withColumn("digest", F.xxhash64("entry"))
    size = listed.agg(F.sum(F.octet_length("entry") + 16)).first()[0]
    if not size:
        return
    stored = materialise(listed, "listed-entries")
    blocks = -(-int(size) // block_bytes)
    # digests are spread evenly, so ranges of equal width hold equal shares
    bounds = [-(1 << 63) + (1 << 64) * i // blocks for i in range(blocks + 1)]
    for low, high in zip(bounds, bounds[1:]):
        rows = stored.where(F.col("digest").between(low, high - 1)).orderBy("digest", "entry").toArrow()
        if rows.num_rows:
            yield file_of(rows), rows.num_rows


_mapped: dict[str, DigestArray] = {}


def mapped(name: str, size: int) -> DigestArray:
    """The array of a shipped file, mapped once in a worker."""
    if name not in _mapped:
        _mapped.clear()
        _mapped[name] = DigestArray(SparkFiles.get(name), size)
    return _mapped[name]


_lists: list[tempfile.TemporaryDirectory] = []


def _ship(spark: SparkSession, data: bytes) -> str:
    """Send a file to all executors, those that come later too; its name there.

    The driver serves it to them from a folder that lives as long as the process.
    """
    if not _lists:
        _lists.append(tempfile.TemporaryDirectory(prefix="presswork-lists-"))
    name = f"digests-{uuid.uuid4().hex}"
    path = os.path.join(_lists[0].name, name)
    with open(path, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(path)
    return name


def _probe(name: str, size: int) -> Callable[..., Column]:
    """Function of host and path: whether the shipped block lists one of their probes."""

    @F.pandas_udf("boolean")
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        array = mapped(name, size)
        for host, path in batches:
            # a batch asks for each distinct host and path once
            code, pairs = pd.factorize(pd.MultiIndex.from_arrays([host, path]))
            asked = [probes_of(h, p) for h, p in pairs]
            hit = array.contains([p for ps in asked for p in ps])
            starts = np.cumsum([0, *(len(ps) for ps in asked)])[:-1]
            yield pd.Series(np.logical_or.reduceat(hit, starts)[code] if asked else np.zeros(0, bool))

    return probe


def add_listed(rows: DataFrame, entries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``listed`` to narrow rows with columns ``host`` and ``path``."""
    spark = rows.sparkSession
    ship_code(spark)
    rows = rows.withColumn("listed", F.lit(False))
    for number, (data, size) in enumerate(list_blocks(entries, block_bytes)):
        if number:
            rows = materialise(rows, "listed")
        rows = rows.withColumn("listed", F.col("listed") | _probe(_ship(spark, data), size)("host", "path"))
    return rows


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES,
               entries: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: key, ``host``, ``path``, ``rule``, ``verdict``, ``listed`` (found in the blocklist, a table of one column)."""
    if entries is None:
        entries = pages.sparkSession.createDataFrame([(h,) for h in BLOCKED_HOSTS], "entry string")
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = add_listed(parts, entries, block_bytes).withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(key, "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce("_rule.verdict", method).alias("verdict"), "listed")
