"""Tables of word runs that are too large for a worker's memory: files of entries sorted by hash, mapped where the texts are."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.session import discard, materialise, ship_code

BLOCK_BYTES = 16 << 20  # of entries that pass the driver at once
MOST_BYTES = 8 << 30  # of all files of a table
TOKENS = 1 << 18  # of texts that are worked on at once
TURN = 21
SEED = 42  # of Spark's xxhash64


def run_key(words: Column) -> Column:
    """Key of a run of words, an array."""
    def turned(h: Column) -> Column:
        return F.shiftleft(h, TURN).bitwiseOR(F.shiftrightunsigned(h, 64 - TURN))

    return F.aggregate(F.transform(words, lambda t: F.xxhash64(t)), F.lit(0).cast("long"), lambda made, h: turned(made).bitwiseXOR(h))


def run_keys(hashes: np.ndarray, length: int) -> np.ndarray:
    """``run_key`` of all runs of ``length`` words, given the words' hashes as unsigned numbers; a run has its first word's place."""
    made = np.zeros(max(len(hashes) - length + 1, 0), np.uint64)
    for k in range(length):
        made = (made << np.uint64(TURN) | made >> np.uint64(64 - TURN)) ^ hashes[k:k + len(made)]
    return made


class Files:
    """What finds entries in a worker: names and key ranges of the files."""

    def __init__(self, blocks: list[tuple[str, int, int]]):
        self.blocks = blocks

    def find(self, keys: np.ndarray, strings_at: Callable[[np.ndarray], pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the listed runs and their values; ``strings_at`` gives the runs, blank between words, at some places."""
        signed, code = np.unique(keys.view(np.int64), return_inverse=True)
        places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, low, high in self.blocks:
            begin, end = np.searchsorted(signed, low), np.searchsorted(signed, high, "right")
            if begin == end:
                continue
            entries = _opened(name)
            listed, words, own = entries["key"].to_numpy(), entries["word"], entries["value"].to_numpy()
            at = np.full(len(signed), -1, np.int64)
            near = np.searchsorted(listed, signed[begin:end])
            hit = (near < len(listed)) & (listed[np.minimum(near, len(listed) - 1)] == signed[begin:end])
            at[begin:end][hit] = near[hit]
            place = np.flatnonzero(at[code] >= 0)
            at = at[code[place]]
            while len(place):  # again only for entries that share a key
                same = pc.equal(words.take(pa.array(at)), strings_at(place)).fill_null(False).to_numpy(zero_copy_only=False)
                places.append(place[same])
                values.append(own[at[same]])
                place, at = place[~same], at[~same] + 1
                more = at < len(listed)
                more[more] = listed[at[more]] == listed[at[more] - 1]
                place, at = place[more], at[more]
        return np.concatenate(places), np.concatenate(values)


_open: dict[str, pa.RecordBatch] = {}


def _opened(name: str) -> pa.RecordBatch:
    """The entries of a shipped file, mapped once in a worker."""
    if name not in _open:
        _open[name] = pa.ipc.open_file(pa.memory_map(SparkFiles.get(name))).get_batch(0)
    return _open[name]


_folders: list[tempfile.TemporaryDirectory] = []


def _ship(spark: SparkSession, entries: pa.Table) -> str:
    """Send a file to all executors, those that come later too; its name there.

    The driver serves it to them from a folder that lives as long as the process.
    """
    if not _folders:
        _folders.append(tempfile.TemporaryDirectory(prefix="presswork-runs-"))
    name = f"runs-{uuid.uuid4().hex}"
    path = os.path.join(_folders[0].name, name)
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, entries.schema) as writer:
        writer.write_batch(entries.combine_chunks().to_batches()[0])
    spark.sparkContext.addFile(path)
    return name


def ship(table: DataFrame, words: Column, value: Column, block_bytes: int | None = None, most_bytes: int | None = None) -> Files | None:
    """Files of the table's runs, ``words`` an array of words, with a whole number each; none if they exceed ``most_bytes``.

    Spark deals the runs to ranges of keys, and only one small range at a time is in the driver.
    """
    ship_code(table.sparkSession)
    listed = table.select(words.alias("_words"), value.cast("long").alias("value")).select(
        run_key(F.col("_words")).alias("key"), F.array_join("_words", " ").alias("word"), "value")
    size = int(listed.agg(F.sum(F.octet_length("word") + 20)).first()[0] or 0)
    if size > (MOST_BYTES if most_bytes is None else most_bytes):
        return None
    stored = materialise(listed.orderBy("key"), "runs")  # so a range is read from few files
    count = max(1, -(-size // (block_bytes or BLOCK_BYTES)))
    # keys are spread evenly, so ranges of equal width hold equal shares
    bounds = [-(1 << 63) + (1 << 64) * i // count for i in range(count + 1)]
    blocks = []
    for low, high in zip(bounds, bounds[1:]):
        rows = stored.where(F.col("key").between(low, high - 1)).toArrow()
        if rows.num_rows:
            rows = rows.sort_by("key")
            rows = rows.set_column(1, "word", rows["word"].cast(pa.string()))
            blocks.append((_ship(table.sparkSession, rows), low, high - 1))
    discard(stored)
    return Files(blocks)


class Tokens:
    """The tokens of some texts one after another, with what is given in an array of the same form ``beside`` them."""

    def __init__(self, texts: pa.Array, beside: pa.Array | None = None):
        sentences = texts.flatten()
        self.given = texts.is_valid().to_numpy(zero_copy_only=False)
        self.sentences = texts.value_lengths().fill_null(0).to_numpy()  # of each text
        self.sizes = sentences.value_lengths().fill_null(0).to_numpy().astype(np.int64)  # of each sentence
        self.flat = sentences.flatten()
        self.beside = None if beside is None else beside.flatten().flatten()
        ends = np.cumsum(self.sizes)
        self.left = np.repeat(ends, self.sizes) - np.arange(len(self.flat)) - 1  # tokens that follow in the sentence

    @cached_property
    def tokens(self) -> pa.Array:
        return self.flat.cast(pa.string())

    @cached_property
    def hashes(self) -> np.ndarray:
        """As Spark's, of the distinct ones."""
        coded = self.tokens.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        own = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in distinct), np.uint64, len(distinct))
        return np.append(own, np.uint64(SEED))[coded.indices.fill_null(len(own)).to_numpy()]

    def joined(self, at: np.ndarray, length: int) -> pa.Array:
        """The runs of ``length`` tokens at some places, blank between tokens."""
        parts = [self.tokens.take(pa.array(at + k)) for k in range(length)]
        return parts[0] if length == 1 else pc.binary_join_element_wise(*parts, " ")

    def runs(self, length: int, files: Files) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the listed runs of ``length`` tokens inside sentences."""
        begin = np.flatnonzero(self.left >= length - 1)
        found, values = files.find(run_keys(self.hashes, length)[begin], lambda at: self.joined(begin[at], length))
        return begin[found], values

    def nested(self, words: pa.Array, sizes: np.ndarray) -> pa.Array:
        """Texts of sentences of so many of the words; null where a text is."""
        sentences = pa.ListArray.from_arrays(_ends(sizes), words)
        return pa.ListArray.from_arrays(_ends(self.sentences), sentences, mask=pa.array(~self.given))


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def in_slices(texts: pa.Array, beside: pa.Array | None = None) -> Iterator[Tokens]:
    """The tokens of a batch, whole texts and some ``TOKENS`` at a time."""
    sizes = np.concatenate([[0], np.cumsum(texts.value_lengths().fill_null(0).to_numpy())])
    tokens = np.concatenate([[0], np.cumsum(texts.flatten().value_lengths().fill_null(0).to_numpy())])[sizes]
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(tokens, tokens[begin] + TOKENS, "right")) - 1)
        yield Tokens(*(x.slice(begin, end - begin) for x in (texts, beside) if x is not None))
        begin = end


def one_text(sentences: pa.Array) -> pa.Array:
    """Sentences as those of a single text."""
    return pa.ListArray.from_arrays(pa.array([0, len(sentences)], pa.int32()), sentences)
