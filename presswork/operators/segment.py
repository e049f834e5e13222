"""Words of several syllables: a lexicon learned from n-gram counts, and the best segmentation with it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.text import LETTER
from presswork.operators import mapped
from presswork.operators.counting import counted, frequent_hashes
from presswork.operators.scale import among, count_cut, fits_broadcast, hash_bits, join_own
from presswork.session import discard, materialise, ship_code

MAX_LENGTH = 4
MIN_COUNT = 5
ROUNDS = 3
NOT_LISTED = 1 << 60


def ngram_counts(df: DataFrame, sentences: str, max_length: int = MAX_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, length, n): all single tokens, and the runs of up to ``max_length`` tokens with a letter that occur ``min_count``
    times inside sentences; tokens are joined by a blank.

    A run is no more frequent than any pair in it. So pairs are counted first, by a hash alone, then by a hash the longer runs whose
    pairs are all frequent, and by their words only runs with a hash seen ``min_count`` times: few of all, and never too few.
    """
    ship_code(df.sparkSession)
    marks = {}

    def places(hashes: np.ndarray, left: np.ndarray, upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, keys) of the runs of letters that no count by a hash has turned away; the hashes are odd for those."""
        lettered = (hashes & np.uint64(1)).astype(bool)
        pairs = (left[:-1] > 0) & lettered[:-1] & lettered[1:]
        whole = np.ones(len(hashes), bool)
        for size in range(2, min(upto, len(hashes)) + 1):
            keys = mapped.run_keys(hashes, size)
            if size == 2 and "pairs" in marks:
                pairs &= among(marks["pairs"].value, keys)
            whole = whole[:len(keys)] & pairs[size - 2:]
            at = np.flatnonzero(whole & among(marks["longer"].value, keys) if size > 2 and "longer" in marks else whole)
            yield size, at, keys[at]

    def hashes_of(least: int, upto: int) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
        def found(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for text in mapped.in_slices(mapped.one_text(batch.column(0))):
                hashes = text.flat.to_numpy(zero_copy_only=False).view(np.uint64)
                yield from (keys for size, _, keys in places(hashes, text.left, upto) if size >= least)

        return found

    lettered = lambda t: F.coalesce(t.rlike(LETTER), F.lit(False))
    odd = lambda t: F.xxhash64(t).bitwiseAND(F.lit(-2)).bitwiseOR(lettered(t).cast("long"))
    single_sentences = df.select(F.explode_outer(sentences).alias("_s"))  # a batch of them is small
    hashed = single_sentences.select(F.transform("_s", odd).alias("_h"))
    for name, least, upto in (("pairs", 2, 2), ("longer", 3, max_length)):
        if max_length >= least:
            hashes = materialise(frequent_hashes(hashed, hashes_of(least, upto), min_count), "run-hashes")
            marks[name] = df.sparkSession.sparkContext.broadcast(hash_bits(hashes, "_h"))
            discard(hashes)

    def rows_of(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for text in mapped.in_slices(mapped.one_text(batch.column(0)), mapped.one_text(batch.column(1))):
            hashes = text.hashes & ~np.uint64(1) | text.beside.to_numpy(zero_copy_only=False).astype(np.uint64)
            single = np.flatnonzero(text.tokens.is_valid().to_numpy(zero_copy_only=False))
            for size, at, keys in [(1, single, hashes[single]), *places(hashes, text.left, max_length)]:
                yield pa.table({"word": text.joined(at, size), "length": pa.repeat(str(size), len(at)), "_h": keys.view(np.int64)})

    given = single_sentences.select("_s", F.transform("_s", lettered).alias("_l"))
    counts = counted(given, ["word", "length"], rows_of).withColumn("length", F.col("length").cast("int"))
    return counts.filter((F.col("length") == 1) | (F.col("n") >= min_count))


def learn_lexicon(df: DataFrame, sentences: str, max_length: int = MAX_LENGTH, min_count: int = MIN_COUNT, rounds: int = ROUNDS) -> DataFrame:
    """(word, length, n, expected, cost): words with the expected number of their uses, and 1000 times its negative log share.

    Each round weighs a run against its splits into two known words: with total T, a run expected e times is a word with
    chance ``e T / (e T + sum of left e times right e)``. So many of its occurrences are words, and of these only as many
    stand alone as are not part of a run one token longer. All counts are whole numbers, so every engine rounds alike. The
    rounds work on the n-gram table; the text is not read again. A single token is always a word, expected at least once.
    """
    counts = materialise(ngram_counts(df, sentences, max_length, min_count), "ngrams")
    key = _key_of(counts)
    tokens = F.split("word", " ")
    part = lambda start, size: key(F.array_join(F.slice(tokens, start, size), " "))
    longer = F.col("length") > 1
    cuts = F.sequence(F.lit(1), F.col("length") - 1)
    splits = materialise(counts.filter(longer).select(key("word").alias("id"), F.explode(F.transform(cuts, lambda i: F.struct(
        i.alias("i"), part(F.lit(1), i).alias("head"), part(i + 1, F.col("length")).alias("rest")))).alias("s")).select("id", "s.*"), "splits")
    kept = ["id", "length", "n", "prefix", "suffix"]
    state = materialise(counts.select(
        key("word").alias("id"), "length", "n", F.when(longer, part(F.lit(1), F.col("length") - 1)).alias("prefix"),
        F.when(longer, part(F.lit(2), F.col("length"))).alias("suffix"), F.col("n").alias("expected")), "expected")
    for number in range(rounds):
        total = state.agg(F.sum("expected")).first()[0] or 0
        known = state.select("id", "expected")
        sides = splits.join(known.withColumnsRenamed({"id": "head", "expected": "e1"}), "head").join(
            known.withColumnsRenamed({"id": "rest", "expected": "e2"}), "rest")
        # added in the order of the cuts, so the sum is the same everywhere
        rivals = materialise(sides.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(
            "i", (F.col("e1").cast("double") * F.col("e2")).alias("v")))).alias("v")).select(
            "id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x["v"]).alias("rival")), "rivals")
        own = F.col("expected").cast("double") * F.lit(float(total))
        chance = F.when(own + F.col("rival") > 0, own / (own + F.col("rival"))).otherwise(0.0)
        runs = state.filter(longer).join(rivals, "id", "left").withColumn("chance", chance)
        judged = runs.select(*kept, "chance").unionByName(state.filter(~longer).select(*kept, F.lit(1.0).alias("chance")))
        judged = materialise(judged.withColumn("used", F.floor(F.col("n") * F.col("chance")).cast("long")), "judged")
        discard(rivals)
        inner = judged.filter(longer).select("used", F.explode(F.array(
            F.struct(F.lit(True).alias("head"), F.col("prefix").alias("id")), F.struct(F.lit(False).alias("head"), F.col("suffix").alias("id")))).alias("p"))
        uses = inner.groupBy(F.col("p.id").alias("id")).agg(
            F.sum(F.when(F.col("p.head"), F.col("used"))).alias("head"), F.sum(F.when(~F.col("p.head"), F.col("used"))).alias("rest"))
        inside = uses.select("id", F.greatest("head", "rest").alias("inside"))
        alone = F.floor((F.col("n") - F.coalesce("inside", F.lit(0))) * F.col("chance")).cast("long")
        before = state
        state = materialise(judged.join(inside, "id", "left").select(*kept, alone.alias("expected")), "expected")
        discard(judged, before)
    expected = F.when(F.col("length") == 1, F.greatest("expected", F.lit(1))).otherwise(F.col("expected"))
    found = state.select("id", "length", expected.alias("expected")).filter("expected > 0")
    total = found.agg(F.sum("expected")).first()[0] or 1
    discard(splits)
    words = counts.withColumn("id", key("word")).join(found, ["id", "length"]).select("word", "length", "n", "expected")
    return words.withColumn("cost", F.round(1000 * F.log(F.lit(float(total)) / F.col("expected"))).cast("long"))


def _key_of(counts: DataFrame) -> Callable[[Column | str], Column]:
    """A hash that tells all words of ``counts`` apart, so that the rounds move numbers and not words. Every part of a run that is
    counted is counted too, so it tells these apart as well."""
    seed = 0
    while True:
        key = lambda word, seed=seed: F.xxhash64(word, F.lit(seed))
        keyed = counts.select("word", key("word").alias("id"))
        shared = keyed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
        of_words = keyed.join(shared, "id").groupBy("id").agg(F.min("word").alias("a"), F.max("word").alias("b"))
        if shared.isEmpty() or of_words.filter("a <> b").isEmpty():
            return key
        seed += 1


def best_path(tokens: list[str], cost: dict[str, int], unknown: int, max_length: int) -> tuple[list[str], int]:
    """Cheapest segmentation of a sentence and its cost; of equal ones the longest last word, and so on backwards."""
    best, length = [0], [0]
    for i in range(1, len(tokens) + 1):
        least, chosen = None, 0
        for k in range(min(max_length, i), 0, -1):
            own = cost.get(tokens[i - 1] if k == 1 else " ".join(tokens[i - k:i]))
            if own is None:
                if k > 1:
                    continue
                own = unknown
            if least is None or best[i - k] + own < least:
                least, chosen = best[i - k] + own, k
        best.append(least)
        length.append(chosen)
    words, i = [], len(tokens)
    while i:
        words.append("_".join(tokens[i - length[i]:i]))
        i -= length[i]
    return words[::-1], best[-1]


def unlisted(text, cost: dict[str, int], marks: bytes, max_length: int) -> list[str] | None:
    """The runs of a text that ``cost`` lacks and whose checksum has its bit set in ``marks``."""
    if text is None:
        return None
    found, mask = set(), len(marks) * 8 - 1
    for tokens in map(list, text):
        for i in range(len(tokens)):
            for k in range(1, min(max_length, len(tokens) - i) + 1):
                word = tokens[i] if k == 1 else " ".join(tokens[i:i + k])
                if word not in cost:
                    slot = crc32(word.encode()) & mask
                    if marks[slot >> 3] >> (slot & 7) & 1:
                        found.add(word)
    return list(found)


SEGMENTED = "struct<words: array<array<string>>, cost: bigint>"


def best_paths(costs: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_path`` of sentences of ``sizes`` tokens, one after another: whether a token begins a word, and each sentence's cost.

    ``costs``: of the runs of one, two and more tokens from each token on, ``NOT_LISTED`` where there is none. All sentences
    go forward together, a token at a time.
    """
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes)
    first, size = (ends - sizes)[order], sizes[order]
    # a sentence has a place before its first token, and one after each
    start = first + order
    best, length = np.zeros(len(costs[0]) + len(sizes), np.int64), np.zeros(len(costs[0]) + len(sizes), np.int64)
    longer = np.searchsorted(-size, -np.arange(1, size[0] + 1 if len(size) else 1), "right")
    for step, n in enumerate(longer.tolist(), 1):
        least, chosen = np.full(n, NOT_LISTED), np.zeros(n, np.int64)
        for k in range(min(len(costs), step), 0, -1):
            whole = best[start[:n] + step - k] + costs[k - 1][first[:n] + step - k]
            better = whole < least
            least, chosen = np.where(better, whole, least), np.where(better, k, chosen)
        best[start[:n] + step], length[start[:n] + step] = least, chosen
    begins = np.zeros(len(costs[0]), bool)
    at, shift = start + size, order
    total = np.zeros(len(sizes), np.int64)
    total[order] = best[at]
    while len(at):
        going = length[at] > 0
        at, shift = at[going], shift[going]
        at = at - length[at]
        begins[at - shift] = True
    return begins, total


def _segmented_beside(df: DataFrame, sentences: str, files: mapped.Files, unknown: int, name: str, max_length: int) -> DataFrame:
    nested = pa.list_(pa.list_(pa.string()))

    def walked(text: mapped.Tokens) -> tuple[pa.Array, pa.Array]:
        costs = [np.full(len(text.tokens), NOT_LISTED if k else unknown, np.int64) for k in range(max_length)]
        for k, own in enumerate(costs, 1):
            place, value = text.runs(k, files)
            own[place] = value
        begins, least = best_paths(costs, text.sizes)
        at = np.flatnonzero(begins).astype(np.int32)
        grouped = pa.ListArray.from_arrays(pa.array(np.append(at, np.int32(len(begins)))), text.tokens)
        upto, ends = np.concatenate([[0], np.cumsum(begins)]), np.concatenate([[0], np.cumsum(text.sizes)])
        of_texts = np.concatenate([[0], np.cumsum(text.sentences)])
        return text.nested(pc.binary_join(grouped, "_"), np.diff(upto[ends])), pa.array(np.diff(np.concatenate([[0], np.cumsum(least)])[of_texts]))

    @F.arrow_udf(SEGMENTED)
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = [walked(text) for text in mapped.in_slices(texts)]
            words, cost = (pa.concat_arrays(x) for x in zip(*made)) if made else (pa.array([], nested), pa.array([], pa.int64()))
            yield pa.StructArray.from_arrays([words, cost], names=["words", "cost"])

    return df.withColumn(name, F.when(F.col(sentences).isNotNull(), walk(F.col(sentences))))


def segment(df: DataFrame, key: str, sentences: str, lexicon: DataFrame, name: str = "segmented", max_length: int = MAX_LENGTH,
            fits: bool | None = None) -> DataFrame:
    """Add a struct of the segmented ``words`` (sentences of words, syllables joined by "_") and their total ``cost``.

    A token that the lexicon does not list costs as much as a word expected once. A lexicon of checked size goes to where
    the rows are, a larger one as files that are looked up there, and nothing is shuffled. Only beyond the files' limit the most
    frequent words do, and a row's own others are joined to it by ``key``, which must then be unique.
    """
    ship_code(df.sparkSession)
    spark = df.sparkSession
    total = lexicon.agg(F.sum("expected")).first()[0] or 1
    unknown = int(spark.range(1).select(F.round(1000 * F.log(F.lit(float(total))))).first()[0])

    def walk(text, cost: dict[str, int]) -> dict | None:
        if text is None:
            return None
        found = [best_path(list(tokens), cost, unknown, max_length) for tokens in text]
        return {"words": [words for words, _ in found], "cost": sum(c for _, c in found)}

    listed = lexicon.select("word", "cost")
    if fits_broadcast(listed) if fits is None else fits:
        share = spark.sparkContext.broadcast({r["word"]: r["cost"] for r in listed.toLocalIterator()})

        @F.pandas_udf(SEGMENTED)
        def with_shared(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield _frame([walk(text, share.value) for text in batch])

        return df.withColumn(name, F.when(F.col(sentences).isNotNull(), with_shared(F.col(sentences))))
    # a token that costs as much as one that is not listed need not be looked up
    needed = listed.filter((F.col("cost") != unknown) | F.contains("word", F.lit(" ")))
    files = mapped.ship(needed, F.split("word", " "), F.col("cost"))
    if files is not None:
        return _segmented_beside(df, sentences, files, unknown, name, max_length)
    stored = materialise(lexicon.select("word", "cost", "n"), "lexicon-words")
    cut = count_cut(stored, "n")
    frequent = (F.col("n") >= cut) if cut is not None else F.lit(False)
    rare = stored.filter(~frequent).select("word", "cost")
    marks = hash_bits(rare.select(F.crc32("word").alias("_h")), "_h").tobytes()
    share = spark.sparkContext.broadcast(({r["word"]: r["cost"] for r in stored.filter(frequent).toLocalIterator()}, marks))

    @F.pandas_udf("array<string>")
    def beyond(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([unlisted(text, *share.value, max_length) for text in batch])

    wanted = df.select(key, F.explode_outer(beyond(F.col(sentences))).alias("word")).filter(F.col("word").isNotNull())
    own = wanted.join(rare.hint("merge"), "word").groupBy(key).agg(F.collect_list(F.struct("word", "cost")).alias("_own"))

    def with_both(text, cost: dict[str, int], words, numbers) -> dict | None:
        if words is None:
            return walk(text, cost)
        cost.update(zip(words, map(int, numbers)))
        try:
            return walk(text, cost)
        finally:
            for word in words:
                cost.pop(word, None)

    @F.pandas_udf(SEGMENTED)
    def with_own(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, words, numbers in batches:
            yield _frame([with_both(t, share.value[0], w, n) for t, w, n in zip(texts, words, numbers)])

    return join_own(df, key, own).withColumn(
        name, F.when(F.col(sentences).isNotNull(), with_own(sentences, "_own.word", "_own.cost"))).drop("_own")


def _frame(rows: list[dict | None]) -> pd.DataFrame:
    return pd.DataFrame({"words": [r and r["words"] for r in rows], "cost": pd.array([r and r["cost"] for r in rows], "Int64")})
