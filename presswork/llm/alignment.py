"""Cross-tokenizer alignment: the ids of two tokenizers over one text, grouped where both end a token.

A text goes with a leading blank through a byte-level tokenizer (A) and as it is through a piece tokenizer
(B), which adds that blank. The cumulative byte ends of either are keys of an end-to-index dictionary; the
sorted intersection of their keys slices both id lists into groups, and inside a slice every A token is
linked with every B token whose byte range overlaps its own. The count of an (A id, B id) pair is the
number of documents that hold it linked, over the whole corpus.

Neither vocabulary joins characters across a blank or a line end, so both tokenizers end at every such
place and a text of plain Latin characters falls into words that align by themselves: a worker aligns each
new word once, all new words of a block of texts in one go, and starts anew beyond ``CACHE_WORDS`` of them. Any other
text is aligned whole. Texts are never cut.

Spark stores the distinct pairs of each document, counts them with partial sums, and looks the counts up
again: the best count of an A id comes from a table as long as A's vocabulary; of the pair counts the
highest, ``HEAD_PAIRS`` at most, go to every task, and only rarer pairs are shuffled to their counts. All
ways give the same numbers.

Null and empty texts, and texts that B does not give back byte by byte, have no tokens: zeros and an
empty digest. Very long texts are rows like any other. Equal counts are all the best. Repeated rows are
documents of their own. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from presswork.llm.common import append_from_text, ship_code
from presswork.session import materialise

VOCABULARY_A = "byte_bpe_50k.tiktoken"
VOCABULARY_B = "piece_bpe_32k.model"
CACHE_WORDS = 300_000
BLOCK_CHARS = 1 << 20
HEAD_PAIRS = 1 << 20
BATCH_ROWS = 2000  # texts whose links a task holds at once

Document = tuple[int, int, int, str, np.ndarray]

def slices(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Numbers of A and of B tokens up to each place where both end; neighbours bound one group."""
    past_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    past_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(past_a.keys() & past_b.keys())
    return list(map(past_a.__getitem__, common)), list(map(past_b.__getitem__, common))


def slice_links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices (A, B) of all token pairs whose byte ranges overlap, slice after slice, and where the overlaps end.

    Inside a slice only one of the two ends a token at a time, so the ranges of a linked pair share exactly
    one stretch between neighbouring ends of either side, and each such stretch is one link.
    """
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = both[np.diff(both, prepend=-1) > 0]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), ends


class Table:
    """Bytes of a vocabulary's entries, and its ids in print: eight bytes each, padded with zeros."""

    def __init__(self, pieces: list[bytes], last: bytes):
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.starts = self.lengths.cumsum() - self.lengths
        self.inside, self.last = (
            np.array([b"%d%s" % (i, mark) for i in range(len(pieces))], "S8").view(np.uint64) for mark in (b",", last))

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.flat[places].tobytes()


@dataclass
class Alignment:
    """Of one text: byte ends of the groups, numbers of A and B ids up to each, the links (A id << 32 | B id)
    with their byte ends, and the groups in print, with the number of printed bytes up to each group."""

    ends: np.ndarray
    past_a: np.ndarray
    past_b: np.ndarray
    links: np.ndarray
    link_ends: np.ndarray
    printed: bytes
    printed_ends: np.ndarray


class Numbers(dict):
    """A number for every word, in the order in which words are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Aligner:
    word = re.compile(r"[ \n][^ \n]+")
    plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+(?:[ \n][!-~À-ÖØ-öø-ÿ]+)*")

    def __init__(self, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, cache_words: int = CACHE_WORDS):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(vocabulary_a), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # without special tokens, so their strings are ordinary text
        self.a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        by_id = {i: b for b, i in ranks.items()}
        self.table_a = Table([by_id.get(i, b"") for i in range(max(by_id) + 1)], b"|")
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary_b))
        pieces = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.table_b = Table(pieces, b";")
        # words stand alone only where no piece reaches across a blank or a line end
        alone = not any(b" " in p.lstrip(b" ") or b"\n" in p[1:] for p in pieces)
        self.cache_words = cache_words if alone else 0
        self._forget()

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode()

    def align(self, full: str) -> Alignment | None:
        """Of a text with its leading blank; None where the tokens of either side do not join up to it."""
        data = full.encode()
        ids_a, ids_b = (np.array(ids, np.int64) for ids in (self.a.encode_ordinary(full), self.b.encode(full[1:])))
        ends_a, ends_b = self.table_a.lengths[ids_a].cumsum(), self.table_b.lengths[ids_b].cumsum()
        if self.table_a.joined(ids_a, ends_a) != data or self.table_b.joined(ids_b, ends_b) != data:
            return None
        past_a, past_b = map(np.array, slices(ends_a.tolist(), ends_b.tolist()))
        at_a, at_b, link_ends = slice_links(ends_a, ends_b)
        # a group's A ids stand behind all B ids of earlier groups, its B ids behind its own A ids too
        places_a = np.arange(len(ids_a)) + np.repeat(past_b - np.diff(past_b, prepend=0), np.diff(past_a, prepend=0))
        places_b = np.arange(len(ids_b)) + np.repeat(past_a, np.diff(past_b, prepend=0))
        shown = np.empty(len(ids_a) + len(ids_b), np.uint64)
        shown[places_a], shown[places_b] = self.table_a.inside[ids_a], self.table_b.inside[ids_b]
        shown[places_a[past_a - 1]], shown[places_b[past_b - 1]] = self.table_a.last[ids_a[past_a - 1]], self.table_b.last[ids_b[past_b - 1]]
        marks = shown.view(np.uint8)
        set_marks = (marks != 0).reshape(-1, 8).sum(1).cumsum()
        return Alignment(ends_a[past_a - 1], past_a, past_b, ids_a[at_a] << 32 | ids_b[at_b], link_ends,
                         marks[marks != 0].tobytes(), set_marks[past_a + past_b - 1])

    def _forget(self) -> None:
        self.number = Numbers()
        self.printed: list[bytes] = []
        self.sizes = np.zeros((0, 3), np.int64)  # of each word: A ids, B ids, groups
        self.links = np.zeros(0, np.int64)
        self.link_ends = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> bool:
        """Align new words in one text, behind a first word that is dropped; False where they do not stand alone."""
        found = self.align(" x" + "".join(words))
        lengths = np.array([2, *(len(w.encode()) for w in words)])
        ends = lengths.cumsum()
        if found is None:
            return False
        last = np.searchsorted(found.ends, ends)
        if last[-1] >= len(found.ends) or (found.ends[last] != ends).any():
            return False
        counts = np.stack([found.past_a[last], found.past_b[last], last + 1], 1)
        link_ends = np.searchsorted(found.link_ends, ends, "right")
        cuts = found.printed_ends[last].tolist()
        self.printed += [found.printed[a:b] for a, b in zip(cuts, cuts[1:])]
        self.sizes = np.concatenate([self.sizes, np.diff(counts, axis=0)])
        self.link_ends = np.concatenate([self.link_ends, link_ends[1:] - link_ends[0] + self.link_ends[-1]])
        self.links = np.concatenate([self.links, found.links[link_ends[0]:]])
        return True

    def _whole(self, text: str) -> Document:
        found = self.align(" " + text) if text else None
        if found is None:
            return 0, 0, 0, "", np.zeros(0, np.int64)
        return int(found.past_a[-1]), int(found.past_b[-1]), len(found.ends), hashlib.sha256(found.printed[:-1]).hexdigest(), found.links

    def _of_words(self, at: np.ndarray) -> Document:
        n_a, n_b, n_groups = self.sizes[at].sum(0).tolist()
        printed = b"".join(map(self.printed.__getitem__, at.tolist()))
        sizes = self.link_ends[at + 1] - self.link_ends[at]
        past = sizes.cumsum()
        places = np.arange(past[-1]) + np.repeat(self.link_ends[at] - past + sizes, sizes)
        return n_a, n_b, n_groups, hashlib.sha256(printed[:-1]).hexdigest(), self.links[places]

    def documents(self, texts: list[str]) -> Iterator[Document]:
        """Of each text: numbers of A and B ids and of groups, digest of the groups, and all links."""
        start = 0
        while start < len(texts):
            past, size = start, 0
            while past < len(texts) and size < BLOCK_CHARS:
                size += len(texts[past])
                past += 1
            yield from self._block(texts[start:past])
            start = past

    def _block(self, texts: list[str]) -> Iterator[Document]:
        if len(self.number) > self.cache_words:
            self._forget()
        numbered = len(self.number)
        words: list[np.ndarray | None] = []
        for text in texts:
            plain = self.cache_words and self.plain.fullmatch(text)
            found = self.word.findall(" " + text) if plain else []
            words.append(np.fromiter(map(self.number.__getitem__, found), np.int64, len(found)) if plain else None)
        if len(self.number) > numbered and not self._learn(list(islice(self.number, numbered, None))):
            self._forget()
            words = [None] * len(texts)
        for text, at in zip(texts, words):
            yield self._whole(text) if at is None else self._of_words(at)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(vocabulary_a: str, vocabulary_b: str) -> Aligner:
    """One aligner for each worker process; its cache outlives a task."""
    if (vocabulary_a, vocabulary_b) not in _aligners:
        _aligners[vocabulary_a, vocabulary_b] = Aligner(vocabulary_a, vocabulary_b)
    return _aligners[vocabulary_a, vocabulary_b]


def with_links(docs: DataFrame, text: str = "text", vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B,
               drop_text: bool = False) -> DataFrame:
    """Add the numbers of one text alone, and its distinct links as arrays ``link_a``, ``link_b`` (ids) and ``link_n``."""

    def make():
        own = aligner(vocabulary_a, vocabulary_b)

        def work(texts: list[str]) -> list[list]:
            out: list[list] = [[] for _ in range(8)]
            for n_a, n_b, n_groups, digest, links in own.documents(texts):
                distinct, times = np.unique(links, return_counts=True)
                pairs = ((distinct >> 32).astype(np.int32), distinct.astype(np.int32), times.astype(np.int32))
                for column, value in zip(out, (n_a, n_b, n_groups, len(links), digest, *pairs)):
                    column.append(value)
            return out

        return work

    return append_from_text(docs, text, "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                            "link_a array<int>, link_b array<int>, link_n array<int>", make, drop_text, rows=BATCH_ROWS)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(link_a, link_b, documents): how many rows hold each pair linked."""
    pairs = linked.select(F.explode(F.arrays_zip("link_a", "link_b")).alias("p"))
    return pairs.groupBy("p.link_a", "p.link_b").agg(F.count(F.lit(1)).alias("documents"))


def _head(counts: DataFrame, head_pairs: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Least count of the head, and its pairs and counts, sorted by pair: at most ``head_pairs`` of them."""
    # few distinct counts come first, so a histogram cut off at head_pairs entries is enough
    top = counts.groupBy("documents").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("documents")).limit(head_pairs)
    upto = Window.orderBy(F.desc("documents")).rowsBetween(Window.unboundedPreceding, 0)
    cut = top.withColumn("upto", F.sum("pairs").over(upto)).where(F.col("upto") <= head_pairs).agg(F.min("documents")).first()[0]
    if cut is None:
        return 1 << 62, np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = F.shiftleft(F.col("link_a").cast("long"), 32).bitwiseOR(F.col("link_b").cast("long"))
    head = counts.where(F.col("documents") >= cut).select(key.alias("pair"), "documents").toArrow()
    pairs, documents = head["pair"].to_numpy(), head["documents"].to_numpy()
    order = np.argsort(pairs)
    return cut, pairs[order], documents[order]


def align_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_a: str = VOCABULARY_A,
                    vocabulary_b: str = VOCABULARY_B, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Per row: key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best`` (links whose pair is
    the most frequent of its A id, ties included) and ``count_sum`` (pair counts summed over links)."""
    spark = docs.sparkSession
    ship_code(spark)
    linked = with_links(docs.select(key, text), text, vocabulary_a, vocabulary_b, drop_text=True)
    linked = materialise(linked.withColumn("_row", F.monotonically_increasing_id()), "links")
    counts = materialise(pair_counts(linked), "pairs")
    # one entry for each A id: as long as the vocabulary at most
    best = counts.groupBy("link_a").agg(F.max("documents").alias("most")).toArrow()
    most = np.zeros(max(best["link_a"].to_pylist(), default=0) + 1, np.int64)
    most[best["link_a"].to_numpy()] = best["most"].to_numpy()
    cut, head, head_counts = _head(counts, head_pairs)
    share = spark.sparkContext.broadcast((head, head_counts, most))
    numbers = [key, "_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rest = T.StructType.fromDDL("n_best long, count_sum long, rare_a array<int>, rare_b array<int>, rare_n array<int>").fields
    schema = T.StructType([*(linked.schema[c] for c in numbers), *rest])
    arrow = to_arrow_schema(schema)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, documents, highest = share.value
        for batch in batches:
            column = batch.column("link_a")
            ids_a = column.flatten().to_numpy().astype(np.int64)
            ids_b, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("link_b", "link_n"))
            sizes = np.diff(column.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            asked = ids_a << 32 | ids_b
            at = np.minimum(np.searchsorted(pairs, asked), max(len(pairs) - 1, 0))
            known = pairs[at] == asked if len(pairs) else np.zeros(len(asked), bool)
            count = np.where(known, documents[at] if len(pairs) else 0, 0)
            n_best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(n_best, row, np.where(known & (count == highest[ids_a]), times, 0))
            np.add.at(total, row, count * times)
            offsets = pa.array(np.r_[0, np.bincount(row[~known], minlength=len(sizes)).cumsum()].astype(np.int32))
            rare = [pa.ListArray.from_arrays(offsets, pa.array(v[~known].astype(np.int32))) for v in (ids_a, ids_b, times)]
            made = [pa.array(n_best), pa.array(total), *(r.cast(f.type) for r, f in zip(rare, list(arrow)[-3:]))]
            kept = [batch.column(c).cast(arrow.field(c).type) for c in numbers]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)

    found = linked.mapInArrow(look_up, schema)
    columns = [c for c in numbers if c != "_row"]
    if counts.where(F.col("documents") < cut).isEmpty():
        return found.select(*columns, "n_best", "count_sum")
    found = materialise(found, "looked-up")
    rare = found.select("_row", F.explode(F.arrays_zip("rare_a", "rare_b", "rare_n")).alias("r")).select(
        "_row", F.col("r.rare_a").alias("link_a"), F.col("r.rare_b").alias("link_b"), F.col("r.rare_n").alias("n"))

    @F.pandas_udf("long")
    def highest_of(ids: pd.Series) -> pd.Series:
        return pd.Series(share.value[2][ids.to_numpy()])

    told = rare.join(counts.where(F.col("documents") < cut), ["link_a", "link_b"]).withColumn("most", highest_of("link_a"))
    added = told.groupBy("_row").agg(
        F.sum(F.when(F.col("documents") == F.col("most"), F.col("n")).otherwise(0)).alias("_best"),
        F.sum(F.col("documents") * F.col("n")).alias("_sum"))
    return found.drop("rare_a", "rare_b", "rare_n").join(added, "_row", "left").select(
        *columns, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))
