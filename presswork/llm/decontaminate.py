"""Benchmark decontamination: an Aho-Corasick automaton over normalised test texts.

Texts are normalised byte by byte: A-Z become lower case, ASCII characters other than letters and
digits separate words, all others belong to words. A pattern is a window of consecutive item words
(or a whole shorter item) between single blanks; a document, joined the same way, is scanned once and
every match ends at a known word, whose place in the original text is known too.

The items are broadcast in blocks of at most ``BLOCK_BYTES``, which are brought over one after another; a
longer item is a block of its own. A worker builds a block's automaton once and keeps the last one. An
automaton takes about 450 bytes for a byte of its items (measured), so a worker needs some 230 MB for it. Further
blocks are further scans, each stored before the next begins.

Null and empty texts have no words and no hits, very long ones are scanned whole; items without words
take no part; repeated item ids count once. Words of an item without an id are hit as well, but it
cannot be listed. With an empty benchmark nothing is hit, and an empty table gives an empty result. Repeated
documents are judged alike; other columns pass through or are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import append_from_text, filter_rows, quoted
from presswork.session import materialise

WINDOW = 10
BLOCK_BYTES = 512 << 10

_SEPARATORS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def normal_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS)


def automaton(items: list[tuple[str | None, str]], window: int = WINDOW):
    """Automaton over (item id, text); a match gives (item numbers, words in the window)."""
    import ahocorasick

    patterns: dict[str, tuple[set[int], int]] = {}
    for number, (_, text) in enumerate(items):
        words = normal_bytes(text).split()
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            # bytes as Latin-1 characters: one character per byte
            pattern = " " + b" ".join(words[i:i + size]).decode("latin-1") + " "
            patterns.setdefault(pattern, (set(), size))[0].add(number)
    machine = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        machine.add_word(pattern, value)
    if patterns:
        machine.make_automaton()
    return machine if patterns else None


def hits(machine, data: bytes) -> tuple[list[tuple[int, int]], set[int]]:
    """Word ranges (first, past last) inside matches, merged where they touch or overlap, and the item numbers."""
    joined = " " + b" ".join(data.split()).decode("latin-1") + " "
    ranges: list[list[int]] = []
    numbers: set[int] = set()
    blanks = None
    for end, (items, size) in machine.iter(joined):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        past = int(np.searchsorted(blanks, end))
        numbers |= items
        ranges.append([past - size, past])
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged], numbers


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text",
           block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """Items as (id, text) in blocks of bounded bytes, brought over one at a time; at least one block."""
    block: list[tuple[str | None, str]] = []
    size = 0
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(key).cast("string"), text, F.octet_length(text).alias("size"))
    for item, body, length in rows.toLocalIterator():
        if block and size + length > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, body))
        size += length
    yield block


_built: dict[str, object] = {}


def built_automaton(name: str, items: list[tuple[str | None, str]], window: int):
    """The automaton of the block of that name: built once in a worker, in place of the one before."""
    if name not in _built:
        _built.clear()
        _built[name] = automaton(items, window)
    return _built[name]


_COLUMNS = "n_words long, hit_ranges array<struct<first: int, past: int>>, items array<string>"


def add_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
             window: int = WINDOW, block_bytes: int = BLOCK_BYTES, drop_text: bool = False) -> DataFrame:
    """Add ``n_words``, ``hit_ranges`` (merged ranges of hit words) and ``items`` (ids, sorted as strings)."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c == text or c not in ("n_words", "hit_ranges", "items")]
    docs = docs.select([quoted(c) for c in columns])
    share = None
    listed = blocks(benchmark, item_key, item_text, block_bytes)
    block, following = next(listed), next(listed, None)
    while block is not None:
        if share:  # a further block: what the ones before have found is stored first
            found = materialise(docs, "hits")
            share.unpersist()
            docs = found.withColumnsRenamed({"hit_ranges": "_ranges", "items": "_items"})
        name, again = uuid.uuid4().hex, share is not None
        share = spark.sparkContext.broadcast(block)

        def make(share=share, name=name):
            machine = built_automaton(name, share.value, window)
            names = [item for item, _ in share.value]

            def work(texts: list[str]) -> list[list]:
                out: list[list] = [[], [], []]
                for t in texts:
                    data = normal_bytes(t)
                    n = len(data.split())
                    ranges, numbers = hits(machine, data) if machine and n else ([], set())
                    out[0].append(n)
                    out[1].append([{"first": a, "past": b} for a, b in ranges])
                    out[2].append(sorted({names[i] for i in numbers if names[i] is not None}))
                return out

            return work

        docs = append_from_text(docs, text, _COLUMNS, make, drop_text and following is None)
        block, following = following, next(listed, None)
        if again:
            docs = docs.withColumn("hit_ranges", _merge_ranges(F.concat("_ranges", "hit_ranges"))).withColumn(
                "items", F.array_sort(F.array_union("_items", "items"))).drop("_ranges", "_items")
    return docs


def _merge_ranges(ranges: F.Column) -> F.Column:
    none = F.array().cast("array<struct<first: int, past: int>>")

    def step(done, r):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1),
                          F.array(F.struct(last["first"].alias("first"), F.greatest(last["past"], r["past"]).alias("past"))))
        return F.when((F.size(done) > 0) & (r["first"] <= F.get(done, F.size(done) - 1)["past"]), longer).otherwise(
            F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), none, step)


def n_hit() -> F.Column:
    return F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda n, r: n + r["past"] - r["first"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The documents without a hit word, with their own columns."""
    return filter_rows(docs, lambda rows, names: add_hits(rows, benchmark, names[text], **settings).where(F.size("hit_ranges") == 0))


def word_offsets(text: str) -> np.ndarray:
    """Code point offsets (start, end) of every word in the original text."""
    data = normal_bytes(text)
    inside = np.concatenate([[0], (np.frombuffer(data, np.uint8) != 32).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside))
    # bytes that begin a character; lower-casing and separating keep every byte's place
    begins = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
    points = np.concatenate([[0], begins.cumsum()])
    return points[edges].reshape(-1, 2)


def hit_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Spans of hit passages in code points of the original text: (key, spans, items), hit documents only."""
    # add_hits has sent the code that the function below needs
    marked = add_hits(docs.select(key, text), benchmark, text, **settings).where("size(hit_ranges) > 0")
    spans = F.udf(lambda t, rs: [[int(o[r["first"]][0]), int(o[r["past"] - 1][1])] for o in [word_offsets(t)] for r in rs],
                  "array<array<int>>")
    return marked.select(key, spans(text, "hit_ranges").alias("spans"), "items")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
