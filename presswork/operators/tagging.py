"""Tags in context: counts of tag pairs and of words by tag, and the best tag sequence of a sentence with them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.operators.scale import fits_broadcast, lookup_join
from presswork.session import discard, materialise, ship_code

START = ""
IMPOSSIBLE = 1 << 40
SUFFIX = 2
ROWS_AT_ONCE = 256  # texts tagged together


def suffix_of(word: Column) -> Column:
    return F.substring(word, -SUFFIX, SUFFIX)


@dataclass
class Tagger:
    """Costs are 1000 times the negative log chance, as whole numbers.

    ``words`` holds (word, n, costs) with a cost for each of ``tags``, null where the word never has that tag; ``suffixes``
    holds (suffix, n, costs) for words that are not listed. Both are tables and may be large. ``first`` (costs of a
    sentence's first tag), ``steps`` (from tag to tag) and ``unseen`` (any other suffix) have one entry per tag or pair.
    """

    tags: list[str]
    first: list[int]
    steps: list[list[int]]
    unseen: list[int]
    words: DataFrame
    suffixes: DataFrame


def _cost(share: Column) -> Column:
    return F.round(-1000 * F.log(share)).cast("long")


def learn_tagger(tagged: DataFrame) -> Tagger:
    """Learn from ``(token, tag, next_tag, first)``, one row per token of a tagged text; ``next_tag`` is null after the last
    token of a sentence, ``first`` marks its first. Words are judged in lower case.

    One pass: rows are counted where they are; all costs come from the stored counts. Steps and suffixes get one added to each
    count, so every sequence of tags is possible; a word that was seen has only the tags it was seen with.
    """
    seen = materialise(tagged.groupBy(F.lower("token").alias("word"), "tag", "next_tag", "first").agg(F.count(F.lit(1)).alias("n")), "tag-counts")
    totals = {r["tag"]: r["n"] for r in seen.groupBy("tag").agg(F.sum("n").alias("n")).collect()}  # one row per tag
    tags = sorted(totals)
    at = {tag: i for i, tag in enumerate(tags)}
    spark = tagged.sparkSession
    pairs = seen.filter("next_tag is not null").groupBy("tag", "next_tag").agg(F.sum("n").alias("n")).unionByName(
        seen.filter("first").groupBy(F.col("tag").alias("next_tag")).agg(F.sum("n").alias("n")).withColumn("tag", F.lit(START)))
    counted = np.zeros((len(tags) + 1, len(tags)), dtype=np.int64)
    for r in pairs.collect():  # tags times tags
        counted[at.get(r["tag"], -1), at[r["next_tag"]]] += r["n"]
    by_suffix = seen.groupBy(suffix_of(F.col("word")).alias("suffix"), "tag").agg(F.sum("n").alias("n"))
    endings = by_suffix.agg(F.count_distinct("suffix")).first()[0]
    shares = [[i, j, int(counted[i, j]) + 1, int(counted[i].sum()) + len(tags)] for i in range(len(tags) + 1) for j in range(len(tags))]
    shares += [[-1, at[tag], 1, totals[tag] + endings] for tag in tags]
    # logarithms of the same engine for all costs
    rows = spark.createDataFrame(shares, "i int, j int, a long, b long").select("i", "j", _cost(F.col("a") / F.col("b")).alias("c")).collect()
    found = {(r["i"], r["j"]): r["c"] for r in rows}

    def listed(counts: DataFrame, word: str, add: int, size: int) -> DataFrame:
        """One row per word with its costs by tag; a tag without a count has no cost, or with ``add`` that of a count of 0."""
        own = counts.groupBy(word).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("_by"))
        costs = [_cost((F.coalesce(F.try_element_at("_by", F.lit(tag)), F.lit(0) if add else F.lit(None)) + add) / F.lit(float(totals[tag] + size)))
                 for tag in tags]
        return materialise(own.select(word, "n", F.array(*costs).cast("array<bigint>").alias("costs")), f"tag-{word}")

    words = listed(seen.groupBy("word", "tag").agg(F.sum("n").alias("n")), "word", 0, 0)
    suffixes = listed(by_suffix, "suffix", 1, endings)
    discard(seen)
    size = range(len(tags))
    return Tagger(tags, [found[len(tags), j] for j in size], [[found[i, j] for j in size] for i in size],
                  [found[-1, j] for j in size], words, suffixes)


def best_tags(costs: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[list[int], int]:
    """Cheapest tag numbers for a sentence, given the costs of each word (rows) by tag, and their total; of equal
    ways the one whose last tag has the lowest number, and so on backwards."""
    total, back = first + costs[0], np.zeros(costs.shape, dtype=np.int32)
    for i in range(1, len(costs)):
        ways = total[:, None] + steps
        back[i] = ways.argmin(0)
        total = ways.min(0) + costs[i]
    tag = int(total.argmin())
    path = [tag]
    for i in range(len(costs) - 1, 0, -1):
        tag = int(back[i, tag])
        path.append(tag)
    return path[::-1], int(total.min())


def best_tags_of(costs: np.ndarray, sizes: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_tags`` of many sentences, one place of all of them at a time: ``costs`` has the words of all, one sentence after
    the other, ``sizes`` their lengths, none of them 0. Tag numbers in the order of the words, and the total of each sentence."""
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    lasts = sizes[order] - 1
    longest = int(lasts[0]) + 1
    going = np.searchsorted(-lasts, -np.arange(longest), side="right")  # sentences that have a word at the place
    total = first + costs[begins]
    back = np.zeros(costs.shape, dtype=np.int32)
    for i in range(1, longest):
        ways = total[:going[i], :, None] + steps
        back[begins[:going[i]] + i] = ways.argmin(1)
        total[:going[i]] = ways.min(1) + costs[begins[:going[i]] + i]
    tag, path = total.argmin(1), np.zeros(len(costs), dtype=np.int64)
    for i in range(longest - 1, -1, -1):
        at = begins[:going[i]] + i
        path[at] = tag[:going[i]]
        if i:
            tag[:going[i]] = back[at, tag[:going[i]]]
    least = np.empty(len(sizes), dtype=np.int64)
    least[order] = total.min(1)
    return path, least


TAGGED = "struct<tags: array<array<string>>, cost: bigint>"


def tag_sequences(df: DataFrame, key: str, sentences: str, model: Tagger, name: str = "tagged", fits: bool | None = None) -> DataFrame:
    """Add a struct of the ``tags`` (sentences of tags, one for each token) and the ``cost`` of all sequences.

    Word and suffix tables of checked size go to where the rows are, and nothing is shuffled. Of larger ones only the entries
    of a row's own words are joined to it by ``key``, which must then be unique. Null stays null; a model
    without tags gives every token a null tag.
    """
    ship_code(df.sparkSession)
    first, steps, unseen = (np.array(x, dtype=np.int64) for x in (model.first, model.steps, model.unseen))
    tags = model.tags

    def walk(texts, words: dict, suffixes: dict) -> list[dict | None]:
        if not tags:
            return [None if t is None else {"tags": [[None] * len(tokens) for tokens in t], "cost": 0} for t in texts]
        places: dict[str, int] = {}
        rows: list[np.ndarray] = []

        def place(token: str) -> int:
            word = token.lower()
            own = words.get(word)
            places[token] = len(rows)
            rows.append(suffixes.get(word[-SUFFIX:], unseen) if own is None else own)
            return places[token]

        sizes = [len(tokens) for text in texts if text is not None for tokens in text if len(tokens)]
        at = [places[t] if t in places else place(t) for text in texts if text is not None for tokens in text for t in tokens]
        path, least = best_tags_of(np.stack(rows)[at], np.array(sizes), first, steps) if at else ((), ())
        named, costs, begin, found = [tags[i] for i in path], iter(least), 0, []
        for text in texts:
            if text is None:
                found.append(None)
                continue
            own = []
            for tokens in text:
                own.append(named[begin:begin + len(tokens)])
                begin += len(tokens)
            found.append({"tags": own, "cost": sum(int(next(costs)) for tokens in own if tokens)})
        return found

    def filled(keys, rows) -> dict[str, np.ndarray]:
        return {k: np.array([IMPOSSIBLE if c is None or c != c else c for c in row], dtype=np.int64) for k, row in zip(keys, rows)}

    def frame(rows: list[dict | None]) -> pd.DataFrame:
        return pd.DataFrame({"tags": [r and r["tags"] for r in rows], "cost": pd.array([r and r["cost"] for r in rows], "Int64")})

    if fits_broadcast(model.words) and fits_broadcast(model.suffixes) if fits is None else fits:
        tables = [[(r[0], r["costs"]) for r in t.toLocalIterator()] for t in (model.words, model.suffixes)]
        share = df.sparkSession.sparkContext.broadcast([filled(*zip(*t)) if t else {} for t in tables])

        @F.pandas_udf(TAGGED)
        def with_shared(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), ROWS_AT_ONCE):
                    yield frame(walk(batch[i:i + ROWS_AT_ONCE], *share.value))

        return df.withColumn(name, F.when(F.col(sentences).isNotNull(), with_shared(F.col(sentences))))
    lowered = F.array_distinct(F.transform(F.flatten(sentences), F.lower))
    for table, column, own in ((model.words, "word", lowered), (model.suffixes, "suffix", F.array_distinct(F.transform(lowered, suffix_of)))):
        listed = lookup_join(df.select(key, F.explode(own).alias(column)), table.select(column, "costs", "n"), [column], spread=[key],
                             how="inner", weight="n", fits=False)
        df = df.join(listed.groupBy(key).agg(F.collect_list(F.struct(column, "costs")).alias(f"_{column}")), key, "left")

    @F.pandas_udf(TAGGED)
    def with_own(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, words, words_costs, suffixes, suffix_costs in batches:
            own = [[{} if k is None else filled(k, c) for k, c in zip(*pair)] for pair in ((words, words_costs), (suffixes, suffix_costs))]
            yield frame([walk([t], w, x)[0] for t, w, x in zip(texts, *own)])

    return df.withColumn(name, F.when(F.col(sentences).isNotNull(), with_own(
        sentences, "_word.word", "_word.costs", "_suffix.suffix", "_suffix.costs"))).drop("_word", "_suffix")
