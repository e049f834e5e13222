"""Ranked lexical search: all items of a query table against all documents, sharing what the items share.

Terms are runs of letters, digits and non-ASCII characters, A-Z in lower case. Documents are read once per
block of items: Spark stores for each its length and how often it has each term of the block, and sums the
corpus statistics from these narrow rows.

Items are evaluated together. ``share_terms`` mines the term sets that items have in common: terms that
occur in the very same items form one set, and the pair of sets that most items share becomes a set of its
own, again and again, until no two items share a pair. The sets are the nodes of a query-sharing graph
without cycles, leaves being terms and roots items. For a batch of documents every node's partial
accumulator is made once, as the sum of its parts, and each item adds up the few nodes it is made of. Sums
are 64-bit integers, so any order of adding gives the same scores.

A task keeps the best rows of each item only; Spark then ranks them first by item and salt, then by item.
A block has at most ``BLOCK_BYTES`` of items (a longer item is a block of its own); blocks come over one at
a time and are worked off one after another.

Null and empty texts have no terms: such documents are never found, such items get no rows. Equal scores
go by ascending key, null keys last. Repeated documents and items are rows of their own. An empty table
gives an empty result. Very long texts are rows like any other; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from presswork.llm.common import append_from_text, ship_code
from presswork.llm.decontaminate import normal_bytes
from presswork.session import materialise

TOP = 20
BLOCK_BYTES = 64 << 10
SALTS = 32
_BATCH_BYTES = 32 << 20  # of accumulators in a task


def terms_of(text: str) -> list[bytes]:
    return normal_bytes(text).split()


@dataclass
class Sharing:
    """Query-sharing graph: row r < ``leaves`` is a term, row ``leaves + i`` the sum of the rows ``nodes[i]``."""

    leaves: int
    nodes: list[list[int]]
    items: list[list[int]]  # rows whose sum is the item


def share_terms(items: list[list[int]], leaves: int) -> Sharing:
    """Mine shared sets from the items' leaf numbers, repeats included."""
    owners: dict[tuple[int, int], list[int]] = defaultdict(list)
    for number, item in enumerate(items):
        for leaf, times in Counter(item).items():
            for nth in range(times):  # the nth occurrence of a leaf is an element of its own, with the same value
                owners[leaf, nth].append(number)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for (leaf, _), numbers in owners.items():
        alike[tuple(numbers)].append(leaf)
    nodes: list[list[int]] = []
    sets: list[set[int]] = [set() for _ in items]
    rest: list[list[int]] = [[] for _ in items]

    def add(parts: list[int]) -> int:
        nodes.append(parts)
        return leaves + len(nodes) - 1

    for numbers, parts in alike.items():
        if len(numbers) == 1:  # shared by nobody
            rest[numbers[0]] += parts
            continue
        row = add(parts)
        for number in numbers:
            sets[number].add(row)

    counts = Counter(pair for s in sets for pair in combinations(sorted(s), 2))
    heap = [(-n, pair) for pair, n in counts.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, (x, y) = heapq.heappop(heap)
        if counts[x, y] != -n:  # the count has changed since
            if counts[x, y] > 1:
                heapq.heappush(heap, (-counts[x, y], (x, y)))
            continue
        both = [s for s in sets if x in s and y in s]
        row = add([x, y])
        for s in both:
            s -= {x, y}
            for other in s:
                for old in (x, y):
                    counts[min(old, other), max(old, other)] -= 1
                counts[other, row] += 1
            s.add(row)
        counts[x, y] = 0
        for other in {o for s in both for o in s if o != row}:
            if counts[other, row] > 1:
                heapq.heappush(heap, (-counts[other, row], (other, row)))
    return Sharing(leaves, nodes, [sorted(s) + r for s, r in zip(sets, rest)])


class Best:
    """The best (score, key) of each item, as (-score, key is null, key)."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.kept: list[list[tuple]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a lower score cannot get in

    def offer(self, item: int, scores: np.ndarray, keys: list) -> None:
        able = np.flatnonzero(scores >= self.least[item])
        if len(able) > 4 * self.top:  # ties with the last one stay
            bar = np.partition(scores[able], -self.top)[-self.top]
            able = able[scores[able] >= bar]
        kept = self.kept[item]
        kept += [(-int(scores[i]), keys[i] is None, keys[i] if keys[i] is not None else 0) for i in able.tolist()]
        if len(kept) > self.top:
            kept.sort()
            del kept[self.top:]
            self.least[item] = -kept[-1][0]


def item_blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """Items with terms, brought over in blocks of bounded bytes."""
    block: list[tuple[object, str]] = []
    size = 0
    for name, body in items.where(F.col(text).isNotNull()).select(key, text).toLocalIterator():
        if block and size + len(body) > block_bytes:
            yield block
            block, size = [], 0
        block.append((name, body))
        size += len(body)
    if block:
        yield block


def with_term_counts(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text", drop_text: bool = False) -> DataFrame:
    """Add ``n_terms``, and ``terms`` and ``times``: the numbers of the document's terms in the vocabulary and their counts."""
    share = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items, so bounded

    def make():
        number = share.value.get

        def work(texts: list[str]) -> list[list]:
            out: list[list] = [[], [], []]
            for t in texts:
                words = terms_of(t)
                found = Counter(map(number, words))
                found.pop(None, None)
                out[0].append(len(words))
                out[1].append(list(found))
                out[2].append(list(found.values()))
            return out

        return work

    return append_from_text(docs, text, "n_terms long, terms array<int>, times array<int>", make, drop_text)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def scores_of(sharing: Sharing, weights: np.ndarray, n_docs: int, n_terms: int, lengths: np.ndarray,
              row: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Scores (item, document) of a batch; ``row``, ``terms`` and ``times`` list its documents' terms."""
    damping = 75 + 25 * lengths * n_docs // n_terms
    partial = np.zeros((sharing.leaves + len(sharing.nodes), len(lengths)), np.int64)
    partial[terms, row] = weights[terms] * (1_000_000_000 * times // (1000 * times + 12 * damping[row]))
    for at, parts in enumerate(sharing.nodes, sharing.leaves):
        partial[at] = partial[parts].sum(0)
    return np.stack([partial[parts].sum(0) for parts in sharing.items])


def _search_block(docs: DataFrame, block: list[tuple[object, str]], key: str, text: str, top: int, item_type: T.StructField) -> DataFrame | None:
    bodies = [terms_of(body) for _, body in block]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in bodies for w in ws))}
    if not vocabulary:
        return None
    spark = docs.sparkSession
    sharing = share_terms([[vocabulary[w] for w in ws] for ws in bodies], len(vocabulary))
    counted = materialise(with_term_counts(docs.select(key, text), vocabulary, text, drop_text=True), "term-counts")
    totals = counted.agg(F.count_if(F.col("n_terms") > 0), F.sum("n_terms")).first()
    if not totals[0]:
        return None
    n_docs, n_terms = totals
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per term of the block
        weights[term] = term_weight(n_docs, df)
    share = spark.sparkContext.broadcast((sharing, weights))
    schema = T.StructType([T.StructField("_item", T.IntegerType()), counted.schema[key], T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_weights = share.value
        found = Best(len(own.items), top)
        step = max(16, _BATCH_BYTES // (8 * (own.leaves + len(own.nodes))))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                lengths = batch.column("n_terms").to_numpy(zero_copy_only=False)
                terms, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
                row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("terms").offsets.to_numpy()))
                keys = batch.column(0).to_pylist()
                for item, scores in enumerate(scores_of(own, own_weights, n_docs, n_terms, lengths, row, terms, times)):
                    found.offer(item, scores, keys)
        rows = [(item, None if null else k, -s) for item, kept in enumerate(found.kept) for s, null, k in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    rows = counted.mapInArrow(best, schema)
    order = [F.desc("score"), F.col(key).asc_nulls_last()]
    salt = F.pmod(F.xxhash64(key, "score"), F.lit(SALTS))
    for window in (Window.partitionBy("_item", "_salt").orderBy(*order), Window.partitionBy("_item").orderBy(*order)):
        rows = rows.withColumn("_salt", salt).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)
    names = spark.createDataFrame(
        [(i, name) for i, (name, _) in enumerate(block)],
        T.StructType([T.StructField("_item", T.IntegerType()), T.StructField("_name", item_type.dataType)]))
    return rows.join(F.broadcast(names), "_item").select(F.col("_name").alias("_item_key"), "rank", key, "score")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (item key, ``rank`` from 1, document key, ``score``): the ``top`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    ship_code(spark)
    item_type = items.schema[item_key]
    found = None
    for block in item_blocks(items, item_key, item_text, block_bytes):
        part = _search_block(docs, block, key, text, top, item_type)
        if part is not None:
            # a block's answers are stored before the next block begins
            part = materialise(part, "ranked")
            found = part if found is None else found.unionByName(part)
    if found is None:
        empty = T.StructType([T.StructField("_item_key", item_type.dataType), T.StructField("rank", T.IntegerType()),
                              docs.schema[key], T.StructField("score", T.LongType())])
        found = spark.createDataFrame([], empty)
    return found.select(F.col("_item_key").alias(item_key), "rank", key, "score")
