"""SimHash near-duplicates: vantage-point trees over Hamming distance.

A fingerprint has 64 bits; a bit is set if it is set in over half the XXH64 values of the text's word
shingles. Fingerprints that differ in at most ``RADIUS`` bits are linked, and a document's component is
what links reach.

Search. Differing bits fall into ``BLOCKS`` bit blocks, so two linked fingerprints differ by at most
``RADIUS // BLOCKS`` bits in one of them. Each block has a vantage-point tree of its own: a node holds a
vantage fingerprint and a distance; members within it go to the inner branch, the others to the outer
one. By the triangle inequality a query needs a branch only if its own distance lies within the block
radius of the branch's side, so queries near a boundary go to both shards and all others to one. The
upper levels of the tree come from a bounded sample of fingerprints and deal members and queries to
shards; inside a shard the tree goes on over its members. At a leaf whole fingerprints are compared,
so every pair found is exact, and none is missed whatever the sample was.

Equal fingerprints are one member. A shard with more members or queries than ``CHUNK`` is cut into chunks
that meet pairwise in separate tasks, so no group grows with the data. A task returns one row for each linked fingerprint,
its smallest linked one as far as the task can see, instead of all pairs; these rows connect exactly what the pairs connect.

A null or empty text has fingerprint zero and is linked like any other. Null keys never name a
component unless all its keys are null. Repeated rows are rows of one component. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import append_from_text, filter_rows, ship_code
from presswork.operators.scale import fits_broadcast
from presswork.session import discard, materialise

WORDS = 4
RADIUS = 4
BLOCKS = 3
SEED = 42
SAMPLE = 20_000  # fingerprints that shape the upper levels of the trees
MEMBERS = 4096  # aimed at in a shard
CHUNK = 8192
LEAF = 96
DROPPED_ROWS = 2_000_000  # keys that may be sent to every task


def fingerprint(text: str, words: int = WORDS) -> int:
    tokens = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = len(tokens) - words + 1
    if n < 2:
        return xxhash.xxh64_intdigest(joined, SEED)
    edges = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts, ends = [0, *edges[:n - 1].tolist()], (edges[words - 1:] - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, drop_text: bool = False) -> DataFrame:
    """Add ``fp``: the fingerprint as a signed long. No shuffle."""

    def make():
        return lambda texts: [np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)]

    return append_from_text(docs, text, "fp long", make, drop_text)


def block_masks(blocks: int = BLOCKS) -> list[np.uint64]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:])]


def distance(a: np.ndarray, b: np.ndarray | np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask)


class Node:
    """Inner branch: distance to the vantage at most ``limit``. A leaf has no vantage but a shard number."""

    __slots__ = ("vantage", "limit", "inner", "outer", "shard")

    def __init__(self, vantage=None, limit=None, inner=None, outer=None, shard=None):
        self.vantage, self.limit, self.inner, self.outer, self.shard = vantage, limit, inner, outer, shard


def split(members: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage, distance limit and inner side that halve ``members`` best; None if they are all alike in the block."""
    vantage = members[len(members) // 2]
    d = distance(members, vantage, mask)
    counts = np.bincount(d)
    if len(counts) == 1:
        return None
    limit = int(np.argmin(np.abs(counts.cumsum()[:-1] - len(members) / 2)))
    return vantage, limit, d <= limit


def upper_tree(sample: np.ndarray, depth: int, mask: np.uint64) -> tuple[Node, int]:
    """Tree of at most ``depth`` levels over a sample, and the number of its shards."""
    shards = 0

    def build(members: np.ndarray, levels: int) -> Node:
        nonlocal shards
        cut = split(members, mask) if levels and len(members) > 1 else None
        if cut is None:
            shards += 1
            return Node(shard=shards - 1)
        vantage, limit, inside = cut
        return Node(vantage, limit, build(members[inside], levels - 1), build(members[~inside], levels - 1))

    root = build(sample, depth)
    return root, shards


def route(node: Node, fps: np.ndarray, at: np.ndarray, mask: np.uint64, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, indices) of the fingerprints that reach each shard; radius -1 deals each to one shard only."""
    if not len(at):
        return
    if node.vantage is None:
        yield node.shard, at
        return
    d = distance(fps[at], node.vantage, mask)
    slack = max(radius, 0)
    yield from route(node.inner, fps, at[d <= node.limit + slack], mask, radius)
    yield from route(node.outer, fps, at[d > node.limit - slack], mask, radius)


class Joined:
    """Components among numbered fingerprints, kept as one label each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, rows: np.ndarray, columns: np.ndarray, near: np.ndarray) -> None:
        """Link ``rows[i]`` with ``columns[j]`` where ``near[i, j]``."""
        for i in np.flatnonzero(near.any(1)).tolist():
            own, linked = self.label[rows[i]], self.label[columns[near[i]]]
            if (linked != own).any():
                labels = np.unique(np.append(linked, own))
                # labels change in place, so the next row already sees them
                self.label[np.isin(self.label, labels)] = labels[0]


def search(members: np.ndarray, queries: np.ndarray, mask: np.uint64, radius: int, block_radius: int, leaf: int = LEAF) -> np.ndarray:
    """Rows (fingerprint, smallest fingerprint linked to it here), for linked fingerprints only."""
    every = np.unique(np.concatenate([members, queries]))
    joined = Joined(len(every))
    m_at, q_at = np.searchsorted(every, members), np.searchsorted(every, queries)

    def visit(m: np.ndarray, q: np.ndarray) -> None:
        if not len(m) or not len(q):
            return
        cut = split(every[m], mask) if len(m) > leaf else None
        if cut is not None:
            vantage, limit, inside = cut
            d = distance(every[q], vantage, mask)
            visit(m[inside], q[d <= limit + block_radius])
            visit(m[~inside], q[d > limit - block_radius])
            return
        for a in range(0, len(q), 512):
            part = q[a:a + 512]
            apart = np.bitwise_count(every[part][:, None] ^ every[m][None, :])
            joined.link(part, m, (apart <= radius) & (apart > 0))

    visit(m_at, q_at)
    # the smallest fingerprint bears the label, and a label of one needs no row
    alone = np.bincount(joined.label, minlength=len(every))[joined.label] < 2
    return np.stack([every[~alone], every[joined.label[~alone]]], 1)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, members: int = MEMBERS, chunk: int = CHUNK,
          sample: int = SAMPLE) -> DataFrame:
    """Rows (a, b) that connect all fingerprints within ``radius``; ``distinct`` is a stored table with column ``fp``."""
    ship_code(distinct.sparkSession)
    total = distinct.count()
    if total < 2:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    # about ``sample`` fingerprints, chosen by a hash of their own
    share = min(1.0, sample / total)
    few = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(share * (1 << 40))).select("fp").toPandas()["fp"]
    few = np.sort(few.to_numpy(np.int64)).view(np.uint64)
    few = np.random.default_rng(0).permutation(few)  # sorted order would tie vantages to the leading bits
    depth = max(0, int(np.ceil(np.log2(total / members))))
    masks, block_radius = block_masks(blocks), radius // blocks
    trees = [upper_tree(few, depth, mask)[0] for mask in masks]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for block, (tree, mask) in enumerate(zip(trees, masks)):
                for is_query, reach in ((False, -1), (True, block_radius)):
                    parts = list(route(tree, fps, np.arange(len(fps)), mask, reach))
                    if parts:
                        at = np.concatenate([p for _, p in parts])
                        shards = np.repeat([s for s, _ in parts], [len(p) for _, p in parts])
                        yield pd.DataFrame({"block": block, "shard": shards, "is_query": is_query, "fp": fps[at].view(np.int64)})

    dealt = materialise(distinct.select("fp").mapInPandas(deal, "block int, shard int, is_query boolean, fp long"), "dealt")
    sizes = dealt.groupBy("block", "shard").agg(
        F.ceil(F.count_if(~F.col("is_query")) / chunk).cast("int").alias("m"),
        F.ceil(F.count_if("is_query") / chunk).cast("int").alias("q")).where("m > 0 and q > 0")
    # a chunk of members meets every chunk of queries of its shard
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("is_query"), F.col("q")).otherwise(F.col("m"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("is_query"), F.col("m")).otherwise(F.col("q")) - 1)
    met = dealt.join(sizes, ["block", "shard"]).select("block", "shard", "is_query", "fp", own.alias("own"), F.explode(others).alias("other"))
    grouped = met.select(
        "block", "shard", F.when(F.col("is_query"), F.col("other")).otherwise(F.col("own")).alias("mc"),
        F.when(F.col("is_query"), F.col("own")).otherwise(F.col("other")).alias("qc"), "is_query", "fp")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        fps, is_query = frame["fp"].to_numpy(np.int64).view(np.uint64), frame["is_query"].to_numpy()
        found = search(fps[~is_query], fps[is_query], masks[int(frame["block"].iloc[0])], radius, block_radius)
        return pd.DataFrame(found.view(np.int64).reshape(-1, 2), columns=["a", "b"])

    found = materialise(grouped.groupBy("block", "shard", "mc", "qc").applyInPandas(compare, "a long, b long").where("a <> b").distinct(), "links")
    discard(dealt)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node of its component.

    Alternates two steps until nothing changes: each node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones. A path of n nodes takes about log n rounds. Every round is a
    stored table, so no lineage grows and a lost executor costs no finished round.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(smallest, "u").select(
            F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")
        ).select("e.*").where("u <> v").distinct()
        superseded, edges = edges, materialise(small, "edges")
        discard(superseded)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS,
                    **search_settings) -> DataFrame:
    """Per row: key, ``fp`` and ``component_id``, the smallest key that links reach."""
    marked = materialise(with_fingerprints(docs.select(key, text), text, words, drop_text=True), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    linked = links(distinct, radius, **search_settings)
    roots = components(linked)
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialise(placed, "placed")
    discard(distinct, linked)
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = placed.join(names, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` less all but one document of each component: the smallest key stays.

    Of several rows with that key in the component one stays; a key's other texts are judged by their own
    components. Rows without a key cannot be named and stay. Texts are not shuffled while the dropped keys fit
    ``DROPPED_ROWS``.
    """
    found = near_duplicates(docs, key, text, **settings)
    known = found.where(F.col(key).isNotNull())
    mixed = materialise(known.groupBy(key).agg(F.min("fp").alias("l"), F.max("fp").alias("h")).where("l < h").select(key), "mixed")
    dropped = materialise(found.where(F.col(key) != F.col("component_id")).select(key).unionByName(mixed).distinct(), "dropped")
    # a list of measured size goes to where the documents are; beyond it rows are dealt by key
    listed = F.broadcast(dropped) if fits_broadcast(dropped, DROPPED_ROWS) else dropped
    left = docs.join(listed, key, "left_anti").select(docs.columns)
    if not known.groupBy(key).count().where("count > 1").isEmpty():
        left = left.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(left.where(F.col(key).isNull()))
    if mixed.isEmpty():
        return left
    # keys with unlike texts: a row stays by its own fingerprint
    stays = materialise(known.where(F.col(key) == F.col("component_id")).join(mixed, key, "left_semi").groupBy(
        F.col(key).alias("_key")).agg(F.min("fp").alias("_fp")), "stays")

    def keep(rows: DataFrame, names: dict[str, str]) -> DataFrame:
        marked = with_fingerprints(rows, names[text], settings.get("words", WORDS))
        chosen = (F.col(names[key]) == F.col("_key")) & (F.col("fp") == F.col("_fp"))
        return marked.join(stays, chosen, "left_semi").dropDuplicates([names[key]])

    return left.unionByName(filter_rows(docs.join(mixed, key, "left_semi").select(docs.columns), keep))
