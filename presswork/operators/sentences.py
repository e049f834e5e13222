"""Sentence ends learned from the texts: which dots belong to abbreviations, and which words begin sentences.

Log-likelihood ratios over counts of words with and without a dot, after Kiss and Strunk, "Unsupervised multilingual
sentence boundary detection" (Computational Linguistics 32, 2006).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.text import LETTER, between_blanks, plain_spaces, strip_chars
from presswork.operators.scale import fits_broadcast, lookup_join
from presswork.session import discard, materialise, ship_code

# Fixed values of the paper: chance of a dot after an abbreviation, and the least scores.
DOT_AFTER_ABBREVIATION = 0.99
MIN_ABBREVIATION = 0.3
MIN_STARTER = 30.0


def line_tokens(text: Column) -> Column:
    """Array (lines) of arrays (tokens with their dots) of the stripped text."""
    return F.transform(F.split(plain_spaces(strip_chars(text)), r"\n+"), between_blanks)


def word_type(token: Column) -> Column:
    """Lower-case token without its final dots."""
    return F.lower(F.regexp_replace(token, r"(?<!\.)\.++\z", ""))


def dot_counts(df: DataFrame, lines: str) -> DataFrame:
    """``(type, dotted, follower, n)``: words with and without a final dot, and the word type after a dot in the same line.

    One reading of the texts, counted where the tokens are. Both models below are made from this table alone.
    """
    seen = F.transform(lines, lambda ts: F.transform(ts, lambda t, i: F.struct(
        word_type(t).alias("type"), t.endswith(".").alias("dotted"),
        F.when(t.endswith("."), word_type(F.get(ts, i + 1))).alias("follower"))))
    return df.select(F.explode(F.flatten(seen)).alias("t")).select("t.*").groupBy("type", "dotted", "follower").agg(F.count(F.lit(1)).alias("n"))


def _plus(k: Column, x: Column) -> Column:
    """``k ln x``, 0 for k = 0."""
    return F.when(k == 0, 0.0).otherwise(k * F.log(x))


def abbreviations(counts: DataFrame, min_score: float = MIN_ABBREVIATION) -> DataFrame:
    """``(type, n_dotted, n_plain, score)`` of the words whose dots are a part of them.

    The ratio of "a dot follows nearly always" to "dots fall on any word alike", times exp(-length), times the number of
    inner dots and one, times length to the power of minus the times seen without a dot. Numbers never count.
    """
    by_type = counts.groupBy("type").agg(
        F.sum(F.when(F.col("dotted"), F.col("n")).otherwise(0)).alias("n_dotted"),
        F.sum(F.when(F.col("dotted"), 0).otherwise(F.col("n"))).alias("n_plain"))
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dotted"), F.col("n")).otherwise(0)).alias("dots")).first()
    share = F.lit((total["dots"] or 0) / (total["n"] or 1))
    dotted, plain = F.col("n_dotted"), F.col("n_plain")
    ratio = -2 * (_plus(dotted, share) + _plus(plain, 1 - share)
                  - dotted * F.log(F.lit(DOT_AFTER_ABBREVIATION)) - plain * F.log(F.lit(1 - DOT_AFTER_ABBREVIATION)))
    length = F.length(F.replace("type", F.lit("."), F.lit("")))
    inner = F.length("type") - length + 1
    score = ratio * F.exp(-length) * inner * F.pow(length, -plain)
    found = by_type.filter((dotted > 0) & F.col("type").rlike(LETTER)).withColumn("score", score)
    return found.filter(F.col("score") >= min_score)


def starters(counts: DataFrame, short: DataFrame, min_score: float = MIN_STARTER) -> DataFrame:
    """``(type, n_after, n, score)`` of the words that stand after a sentence's end more often than by chance.

    Ends are the dots of words that are neither abbreviations nor numbers. Score: twice the log-likelihood ratio of
    two chances (after an end, elsewhere) to one.
    """
    ends = counts.filter(F.col("dotted") & F.col("follower").isNotNull() & F.col("type").rlike(LETTER))
    ends = lookup_join(ends, short.select("type", F.lit(True).alias("_short"), F.col("n_dotted")), ["type"], spread=["follower"],
                       weight="n_dotted").filter(F.col("_short").isNull())
    after = ends.groupBy(F.col("follower").alias("type")).agg(F.sum("n").alias("n_after"))
    after = materialise(after.filter(F.col("type").rlike(LETTER)), "after-ends")
    n_ends = after.agg(F.sum("n_after")).first()[0] or 0
    n_all = counts.agg(F.sum("n")).first()[0] or 0
    joined = after.join(counts.groupBy("type").agg(F.sum("n").alias("n")), "type")
    both, own, first, rest = F.col("n_after"), F.col("n"), F.lit(n_ends), F.lit(n_all - n_ends)
    chance, chance_1, chance_2 = own / F.lit(n_all), both / first, (own - both) / rest

    def likely(k: Column, n: Column, x: Column) -> Column:
        return _plus(k, x) + _plus(n - k, 1 - x)

    score = 2 * (likely(both, first, chance_1) + likely(own - both, rest, chance_2)
                 - likely(both, first, chance) - likely(own - both, rest, chance))
    scored = joined.withColumn("score", score).filter((F.col("score") >= min_score) & (chance_1 > chance))
    return scored.select("type", "n_after", "n", "score")


def learn(df: DataFrame, lines: str) -> tuple[DataFrame, DataFrame]:
    """Abbreviations and sentence starters of the texts, both stored."""
    counts = materialise(dot_counts(df, lines), "dot-counts")
    short = materialise(abbreviations(counts), "abbreviations")
    first = materialise(starters(counts, short), "starters")
    discard(counts)
    return short, first


def _sentences(lines, short, first) -> list[str]:
    out = []
    for tokens in lines:
        begun: list[str] = []
        for i, token in enumerate(tokens):
            begun.append(token)
            if not token.endswith("."):
                continue
            follower = tokens[i + 1] if i + 1 < len(tokens) else None
            inside = follower is not None and token.rstrip(".").lower() in short and not (
                follower[0].isupper() and follower.rstrip(".").lower() in first)
            if not inside:
                out.append(" ".join(begun))
                begun = []
        if begun:
            out.append(" ".join(begun))
    return out


def split_learned(df: DataFrame, key: str, lines: str, short: DataFrame, first: DataFrame, name: str = "sentences",
                  fits: bool | None = None) -> DataFrame:
    """Add the array of sentences: they end with the line, and at a word's dot, but not at that of an abbreviation unless a
    capitalised sentence starter follows.

    Word lists of checked size go to where the rows are, and nothing is shuffled; of larger ones only a row's own words are
    joined to it by ``key``, which must then be unique. Null texts stay null, texts without tokens have no sentences.
    """
    ship_code(df.sparkSession)
    lists = [short.select("type", F.col("n_dotted").alias("n"), F.lit("short").alias("kind")),
             first.select("type", "n", F.lit("first").alias("kind"))]
    if all(fits_broadcast(x.select("type")) for x in lists) if fits is None else fits:
        share = df.sparkSession.sparkContext.broadcast(
            [frozenset(r["type"] for r in x.select("type").toLocalIterator()) for x in lists])

        @F.pandas_udf("array<string>")
        def with_shared(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([None if text is None else _sentences(text, *share.value) for text in batch])

        return df.withColumn(name, with_shared(lines))
    types = F.array_distinct(F.transform(F.flatten(lines), word_type))
    own = df.select(key, F.explode(types).alias("type"))
    for x, kind in zip(lists, ("_short", "_first")):
        listed = lookup_join(own, x.select("type", "n"), ["type"], spread=[key], how="inner", weight="n", fits=False)
        df = df.join(listed.groupBy(key).agg(F.collect_list("type").alias(kind)), key, "left")

    @F.pandas_udf("array<string>")
    def with_own(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, shorts, firsts in batches:
            yield pd.Series([
                None if t is None else _sentences(t, *(frozenset(() if x is None else x) for x in (s, f)))
                for t, s, f in zip(texts, shorts, firsts)])

    return df.withColumn(name, with_own(lines, "_short", "_first")).drop("_short", "_first")
