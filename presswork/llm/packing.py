"""Best-fit packing of token pieces into sequences of a fixed length by exact-complement hashing.

Documents are encoded and only those beyond the limit are cut. Packing works on the histogram of
piece lengths, which has at most ``limit`` entries at any corpus size: for the longest length left,
a hash index of single, pair and triple length sums names combinations that fill the gap exactly,
and such a pattern is consumed as often as the counts allow. Pieces without an exact complement are
placed best-fit: the longest length that still fits, again and again. A pattern is repeated while its
lengths last, so the plan has a few thousand runs however many pieces there are. Spark then numbers
the pieces by (length, key, piece) and looks up each number in the plan.

Null and empty texts are one piece, the end id alone. Rows with equal keys are separate documents.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from presswork.llm.common import in_steps, ship_code
from presswork.operators.scale import with_position
from presswork.session import materialise

VOCABULARY = "word_bpe_49k.json"
LIMIT = 4096
END_ID = 1
CACHE_WORDS = 1_000_000
ID_ROWS = 1000


class Words(dict):
    """Ids of lower-cased words, made when first asked for; emptied at ``limit`` entries."""

    def __init__(self, tokenize, limit: int):
        super().__init__()
        self.tokenize, self.limit = tokenize, limit
        # printable bytes stand for themselves, the others for code points from 256 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = sorted(set(range(256)).difference(printable))
        self.letters = {b: 256 + n for n, b in enumerate(others)}

    def __missing__(self, word: str) -> bytes:
        form = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.tokenize(form)]).tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian bytes.

    A text of plain Latin characters needs no normalisation but the lower case; it is cut into words by
    the vocabulary's own pattern and each distinct word is encoded once, in a cache of bounded size.
    Any other text is cut at blanks and line ends, which the vocabulary never joins across: plain
    parts take the same way, the rest goes through the tokenizer whole.
    """

    plain = re.compile(r"[ \n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    word = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ \na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, vocabulary: str = VOCABULARY, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.words = Words(self.tokenizer.model.tokenize, cache_words)

    def _plain(self, text: str) -> bool:
        return bool(self.plain.fullmatch(text)) and "<|" not in text

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.word.findall(text.lower())))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self._plain(text):
                out.append(self._ids(text))
            else:
                chunks = text.replace("\n", " ").split(" ")
                out.append(b"".join(
                    self._ids(c) if self._plain(c)
                    else np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in chunks))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each worker process; its cache outlives a task."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = END_ID,
                 vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32[, ids]); ``ids`` are little-endian 32-bit ids."""
    ship_code(docs.sparkSession)
    src = docs.select(key, text)
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    schema = T.StructType([src.schema[key], *T.StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(vocabulary)
        # ids are held for few texts at once
        for batch in (b for whole in batches for b in in_steps(whole, ID_ROWS if with_ids else None)):
            cols: list[list] = [[] for _ in range(6)]
            for row, ids in enumerate(enc.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at:at + 4 * limit]
                    for col, v in zip(cols, (row, piece, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        col.append(v)
            keys = batch.column(0).take(pa.array(cols[0], pa.int64())).cast(arrow.field(0).type)
            made = [pa.array(c, f.type) for c, f in zip(cols[1:], list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([keys, *made], names=schema.names)

    return src.mapInArrow(run, schema)


class SumIndex:
    """Hash index from a gap to one, two or three lengths in stock that add up to it.

    An entry is made when its sum is first asked for and made anew when its stock has run out. Stock
    only shrinks, so a sum without a combination never gets one again.
    """

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self.lengths = sorted(counts)
        self.pairs: dict[int, tuple[int, ...] | None] = {}
        self.triples: dict[int, tuple[int, ...] | None] = {}

    def available(self, parts: tuple[int, ...]) -> bool:
        return all(self.counts.get(p, 0) >= parts.count(p) for p in parts)

    def _search_pair(self, total: int, held: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """The pair with the largest first length that is in stock besides ``held``."""
        for a in reversed(self.lengths[:bisect_left(self.lengths, total)]):
            if 2 * a < total:
                return None
            if self.counts.get(a, 0) and self.counts.get(total - a, 0) and self.available((*held, a, total - a)):
                return (a, total - a)
        return None

    def pair(self, total: int, held: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        if total not in self.pairs or self.pairs[total] and not self.available(self.pairs[total]):
            self.pairs[total] = self._search_pair(total)
        found = self.pairs[total]
        return found if found is None or self.available((*held, *found)) else self._search_pair(total, held)

    def triple(self, total: int) -> tuple[int, ...] | None:
        known = self.triples.get(total, ())
        if known is None or known and self.available(known):
            return known
        self.triples[total] = None
        for a in reversed(self.lengths[:bisect_left(self.lengths, total)]):
            if 3 * a < total:
                break
            rest = self.pair(total - a, (a,)) if self.counts.get(a, 0) else None
            if rest:
                self.triples[total] = (a, *rest)
                break
        return self.triples[total]

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.counts.get(gap, 0) else self.pair(gap) or self.triple(gap)

    def drop(self, length: int) -> None:
        del self.counts[length]
        del self.lengths[bisect_left(self.lengths, length)]


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``([(length, times)], repeats)`` that use up the histogram; no pattern exceeds ``limit``."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    index = SumIndex(counts)
    patterns = []
    while counts:
        top = index.lengths[-1]
        counts[top] -= 1  # held back while its complement is looked up
        rest = index.exact(limit - top) if top < limit else ()
        counts[top] += 1
        times = Counter([top, *(_best_fit(index, top, limit) if rest is None else rest)])
        repeats = min(counts[p] // t for p, t in times.items())
        for p, t in times.items():
            counts[p] -= t * repeats
            if not counts[p]:
                index.drop(p)
        patterns.append((sorted(times.items(), reverse=True), repeats))
    return patterns


def _best_fit(index: SumIndex, top: int, limit: int) -> list[int]:
    """Longest pieces that still fit after ``top``; an exact complement ends the search."""
    parts, used, gap = [], Counter([top]), limit - top
    at = bisect_right(index.lengths, gap)
    while gap and at:
        n = index.lengths[at - 1]
        left = index.counts[n] - used[n]
        if n > gap or left < 1:
            at -= 1
            continue
        parts.append(n)
        used[n] += 1
        gap -= n
        rest = index.exact(gap) if gap else None
        if rest and all(index.counts[p] >= c for p, c in (used + Counter(rest)).items()):
            return parts + list(rest)
    return parts


def plan_runs(patterns: list[tuple[list[tuple[int, int]], int]], histogram: dict[int, int]) -> np.ndarray:
    """The plan as runs over piece numbers in order of length: rows (first number, sequence, offset, times, length).

    Piece ``first + i`` of a run goes to ``sequence + i // times`` at ``offset + i % times * length``.
    """
    starts, at = {}, 0
    for n in sorted(histogram):
        starts[n], at = at, at + histogram[n]
    rows, sequence = [], 0
    for parts, repeats in patterns:
        offset = 0
        for n, times in parts:
            rows.append((starts[n], sequence, offset, times, n))
            starts[n] += times * repeats
            offset += times * n
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored rows (key, piece, length, ...); no row is longer than ``limit``.

    Ids stay out of the sort that numbers the pieces and are joined to the places.
    """
    ship_code(pieces.sparkSession)
    if "ids" in pieces.columns:
        placed = pack(pieces.drop("ids"), key, limit)
        return placed.join(pieces.select("_piece", "ids"), "_piece").drop("_piece")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan_runs(plan(histogram, limit), histogram)
    numbered = with_position(pieces, "length", key, "piece", name="_number")

    @F.pandas_udf("sequence_id long, offset long")
    def place(numbers: pd.Series) -> pd.DataFrame:
        n = numbers.to_numpy()
        first, sequence, offset, times, length = runs[np.searchsorted(runs[:, 0], n, "right") - 1].T
        i = n - first
        return pd.DataFrame({"sequence_id": sequence + i // times, "offset": offset + i % times * length})

    return numbered.withColumn("_place", place("_number")).select(
        *[c for c in pieces.columns if c not in ("sequence_id", "offset")], "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = END_ID,
                   vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Encode, cut and place all documents. The pieces are stored once, so nothing is encoded twice."""
    pieces = token_pieces(docs, key, text, limit, end_id, vocabulary, with_ids)
    if with_ids:
        pieces = pieces.withColumn("_piece", F.monotonically_increasing_id())
    return pack(materialise(pieces, "pieces"), key, limit)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids) from rows that carry ``ids``.

    A sequence has ``limit`` ids at most, so each group is small.
    """
    part = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(part.alias("parts")).select(
        "sequence_id", F.expr("unhex(array_join(transform(parts, p -> hex(p.ids)), ''))").alias("ids"))
