"""Word-level operators: token tables, tags, compound words, vocabulary, token ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.labels import FIRST_WORD_ID, UNKNOWN_ID
from presswork.functions.text import (
    DROP_LITERALS,
    DROP_TAGS,
    is_kept,
    kept_words,
    rule_tag,
    sentence_words,
)
from presswork.operators import mapped
from presswork.operators.counting import counted, frequent_hashes
from presswork.operators.scale import among, count_cut, fits_broadcast, hash_bits, hash_filter, join_own, lookup_join, with_position
from presswork.session import discard, materialise, ship_code

HEAD_WORDS = 100_000  # whose counts are broadcast when pairs are scored


def _all_tokens(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """``token_table`` with one row of nulls for a text without tokens."""
    # the outer forms: the inner ones make the optimizer compute the words again in a size filter
    per_sentence = df.select(key, *keep, F.posexplode_outer(sentence_words(F.col(text))).alias("sent", "_words"))
    numbered = per_sentence.select(key, *keep, "sent", "_words", F.posexplode_outer("_words").alias("pos", "token"))
    return numbered.select(key, *keep, "sent", "pos", "token", F.get("_words", F.col("pos") + 1).alias("next_token"))


def token_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per token: ``(key, sent, pos, token, next_token)``; null after a sentence's last token.

    Tokens keep the partitioning of ``df``: operators that need a document's tokens together
    shuffle nothing if its rows were dealt by ``key`` before.
    """
    return _all_tokens(df, key, text).filter(F.col("token").isNotNull())


def preprocess(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """Processed text by the tag rules alone: a narrow projection, no shuffle."""
    return df.select(key, F.array_join(kept_words(F.col(text)), " ").alias("processed_content"), *keep)


def tag_tokens(tokens: DataFrame, lexicon: DataFrame | None, key: str) -> DataFrame:
    """Add ``tag``: from the lexicon table ``(token, tag)`` where listed, else by rule."""
    if lexicon is None:
        return tokens.withColumn("tag", rule_tag(F.col("token")))
    tagged = lookup_join(tokens, lexicon.select("token", "tag"), ["token"], spread=[key, "sent", "pos"])
    return tagged.withColumn("tag", F.coalesce("tag", rule_tag(F.col("token"))))


def drop_tags(tagged: DataFrame, drop=DROP_TAGS, literals=DROP_LITERALS) -> DataFrame:
    return tagged.filter(is_kept(F.col("token"), drop, literals, F.col("tag")))


def _tags_in_rows(words: Column, lexicon: DataFrame) -> Column:
    listed = lexicon.select("token", "tag").toArrow()  # of checked size
    share = lexicon.sparkSession.sparkContext.broadcast(listed.combine_chunks())

    @F.arrow_udf("array<string>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, tags = (share.value.column(i).combine_chunks() for i in range(2))
        for texts in batches:
            found = tags.take(pc.index_in(texts.flatten().cast(tokens.type), value_set=tokens))
            ends = np.concatenate([[0], np.cumsum(texts.value_lengths().fill_null(0).to_numpy())])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.cast(pa.string()))

    return look_up(words)


def _kept_in_rows(marked: DataFrame, key: str, lexicon: DataFrame, drop) -> DataFrame:
    flat = marked.select(key, F.flatten("_sentences").alias("_words"))
    tagged = flat.withColumn("_tags", _tags_in_rows(F.col("_words"), lexicon))
    word = lambda t, tag: F.when(is_kept(t, drop, DROP_LITERALS, F.coalesce(tag, rule_tag(t))), F.lower(t))
    return tagged.select(key, F.array_join(F.zip_with("_words", "_tags", word), " ").alias("processed_content"))


def preprocess_with_tables(df: DataFrame, key: str, text: str, phrases: DataFrame | None = None,
                           lexicon: DataFrame | None = None, drop=DROP_TAGS) -> DataFrame:
    """Full preprocessing with compound words and a tag lexicon: one row per key.

    Compound words are merged and, with a lexicon of checked size, tags looked up inside the rows: nothing is shuffled but
    the keys, to find repeated ones. The texts of a repeated key, and all beside a larger lexicon, become tokens that are gathered by
    key, sentence and place. A text of which nothing is kept gives ``''``, a null text stays null.
    """
    marked = df.select(key, sentence_words(F.col(text)).alias("_sentences"))
    if phrases is not None:
        marked = apply_phrases(marked, key, "_sentences", phrases, "_sentences")
    if lexicon is None or not fits_broadcast(lexicon):
        return _kept_by_key(marked, key, lexicon, drop)
    repeated = materialise(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(F.col(key).alias("_key")), "repeated")
    if repeated.isEmpty():
        return _kept_in_rows(marked, key, lexicon, drop)
    same = F.col(key).eqNullSafe(F.col("_key"))
    once = _kept_in_rows(marked.join(repeated, same, "left_anti"), key, lexicon, drop)
    return once.unionByName(_kept_by_key(marked.join(repeated, same, "left_semi"), key, lexicon, drop))


def _kept_by_key(marked: DataFrame, key: str, lexicon: DataFrame | None, drop) -> DataFrame:
    given = marked.withColumn("_given", F.col("_sentences").isNotNull()).repartition(key)
    tokens = given.select(key, "_given", F.posexplode_outer("_sentences").alias("sent", "_words")).select(
        key, "_given", "sent", F.posexplode_outer("_words").alias("pos", "token"))
    tagged = tag_tokens(tokens, lexicon, key)
    word = F.struct("sent", "pos", F.lower("token").alias("w"))
    kept = F.when(is_kept(F.col("token"), drop, DROP_LITERALS, F.col("tag")), word)
    texts = tagged.groupBy(key).agg(F.collect_list(kept).alias("_w"), F.max("_given").alias("_given"))
    joined = F.array_join(F.transform(F.array_sort("_w"), lambda s: s["w"]), " ")
    return texts.select(key, F.when(F.col("_given"), joined).alias("processed_content"))


def preprocess_quality(df: DataFrame, key: str, text: str) -> DataFrame:
    """Counts per document: sentences, sentences with no kept token, tokens, kept tokens."""
    counted = df.select(key, sentence_words(F.col(text)).alias("_s")).select(
        key, F.transform("_s", F.size).alias("_all"),
        F.transform("_s", lambda s: F.size(F.filter(s, lambda t: is_kept(t)))).alias("_kept"),
    )

    def total(sizes: str) -> Column:
        return F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n)

    return counted.select(
        key,
        F.size("_all").alias("n_sentences"),
        F.size(F.filter("_kept", lambda n: n == 0)).alias("n_dropped_sentences"),
        total("_all").alias("n_tokens"),
        total("_kept").alias("n_kept"),
    )


def learn_phrases(tokens: DataFrame, min_count: int = 5, threshold: float = 1.0, discount: float = 5.0) -> DataFrame:
    """Collocations ``(w1, w2, n12, n1, n2, score)`` with score ``(n12 - discount) * N / (n1 * n2)``.

    Most pairs of a large text are rare, so they are counted twice: first all by a hash alone, then by their words only those
    whose hash is seen ``min_count`` times, in one shuffle with the tokens that begin no such pair. A hash that several
    pairs share lets too many through, never too few, and their own counts are exact.
    """
    ship_code(tokens.sparkSession)
    hashed = tokens.select(
        F.col("token").alias("w1"), F.col("next_token").alias("w2"), F.xxhash64("token").alias("_t"),
        F.when(F.col("next_token").isNotNull(), F.xxhash64("token", "next_token")).alias("_h"))
    often = frequent_hashes(hashed.select("_h"), lambda batch: [batch.column(0).drop_null().to_numpy().view(np.uint64)], min_count)
    hashes = materialise(often, "pair-hashes")
    share = tokens.sparkSession.sparkContext.broadcast(hash_bits(hashes, "_h"))

    def with_frequent(batch: pa.RecordBatch) -> list[pa.Table]:
        first, second, own, pair = (batch.column(i) for i in range(4))
        known = pair.is_valid().to_numpy(zero_copy_only=False)
        whole = pair.fill_null(0).to_numpy()
        listed = known & among(share.value, whole)
        second = pc.if_else(pa.array(listed), second, pa.scalar(None, second.type))
        return [pa.table({"w1": first, "w2": second, "_h": np.where(listed, whole, own.to_numpy())})]

    counts = materialise(counted(hashed, ["w1", "w2"], with_frequent), "phrase-counts")
    discard(hashes)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    frequent = counts.filter(F.col("w2").isNotNull() & (F.col("n") >= min_count)).select("w1", "w2", F.col("n").alias("n12"))
    singles = counts.groupBy("w1").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    singles = materialise(singles, "phrase-words")
    first = singles.select("w1", F.col("n").alias("n1"), F.col("n").alias("_n"))
    second = singles.select(F.col("w1").alias("w2"), F.col("n").alias("n2"), F.col("n").alias("_n"))
    joined = lookup_join(frequent, first, ["w1"], spread=["w2"], how="inner", max_rows=HEAD_WORDS, weight="_n")
    joined = lookup_join(joined, second, ["w2"], spread=["w1"], how="inner", max_rows=HEAD_WORDS, weight="_n")
    score = (F.col("n12") - F.lit(discount)) * F.lit(float(total)) / (F.col("n1") * F.col("n2"))
    return joined.select("w1", "w2", "n12", "n1", "n2", score.alias("score")).filter(F.col("score") > threshold)


def _merged(text, listed) -> list[list[str]] | None:
    """Sentences with their pairs joined, left to right; ``listed`` gives the second words of a first one."""
    nothing: frozenset[str] = frozenset()

    def sentence(tokens: list[str]) -> list[str]:
        out, i, last = [], 0, len(tokens) - 1
        while i <= last:
            if i < last and tokens[i + 1] in listed(tokens[i], nothing):
                out.append(f"{tokens[i]}_{tokens[i + 1]}")
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        return out

    return None if text is None else [sentence(tokens.tolist()) for tokens in text]


def _by_first(pairs) -> dict[str, set[str]]:
    found: dict[str, set[str]] = {}
    for w1, w2 in pairs:
        found.setdefault(w1, set()).add(w2)
    return found


def _merged_in_rows(df: DataFrame, sentences: str, phrases: DataFrame, name: str) -> DataFrame:
    ship_code(df.sparkSession)
    share = df.sparkSession.sparkContext.broadcast(_by_first(phrases.select("w1", "w2").toLocalIterator()))  # of checked size

    @F.pandas_udf("array<array<string>>")
    def merge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_merged(text, share.value.get) for text in batch])

    return df.withColumn(name, merge(F.col(sentences)))


def _merged_by_own(df: DataFrame, key: str, sentences: str, phrases: DataFrame, name: str) -> DataFrame:
    ship_code(df.sparkSession)
    may_be = hash_filter(phrases.select(F.xxhash64("w1", "w2").alias("_h")), "_h")
    numbered = df.select(key, F.explode_outer(sentences).alias("_words")).select(
        key, "_words", F.posexplode_outer("_words").alias("pos", "w1")).select(key, "w1", F.get("_words", F.col("pos") + 1).alias("w2"))
    seen = numbered.filter(F.col("w2").isNotNull()).withColumn("_h", F.xxhash64("w1", "w2"))
    tried = materialise(seen.filter(may_be(F.col("_h"))).select(key, "w1", "w2"), "phrase-places")
    weight = "n12" if "n12" in phrases.columns else None
    own = lookup_join(tried, phrases.withColumn("_listed", F.lit(True)), ["w1", "w2"], spread=[key], how="inner", weight=weight)
    pairs = own.groupBy(key).agg(F.collect_set(F.struct("w1", "w2")).alias("_own"))

    @F.pandas_udf("array<array<string>>")
    def merge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch, firsts, seconds in batches:
            yield pd.Series([_merged(text, _by_first(() if w1 is None else zip(w1, w2)).get) for text, w1, w2 in zip(batch, firsts, seconds)])

    return join_own(df, key, pairs).withColumn(name, merge(sentences, "_own.w1", "_own.w2")).drop("_own")


def _merged_texts(text: mapped.Tokens, files: mapped.Files) -> pa.Array:
    listed = np.zeros(len(text.tokens), bool)
    listed[text.runs(2, files)[0]] = True
    place = np.arange(len(listed))
    # every second of consecutive listed pairs starts a merge, counted from the first; none follows a sentence's last token
    free = np.maximum.accumulate(np.where(listed, -1, place)) if len(listed) else place
    starts = listed & ((place - free) % 2 == 1)
    kept = ~np.concatenate([[False], starts])[:len(starts)]
    begin = np.flatnonzero(starts)
    joined = pc.binary_join_element_wise(text.tokens.take(pa.array(begin)), text.tokens.take(pa.array(begin + 1)), "_")
    merged = pc.replace_with_mask(text.tokens, pa.array(starts), joined).filter(pa.array(kept))
    upto, ends = np.concatenate([[0], np.cumsum(kept)]), np.concatenate([[0], np.cumsum(text.sizes)])
    return text.nested(merged, np.diff(upto[ends]))


def _merged_beside(df: DataFrame, sentences: str, files: mapped.Files, name: str) -> DataFrame:
    def merged(texts: pa.Array) -> pa.Array:
        made = [_merged_texts(text, files) for text in mapped.in_slices(texts)]
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.list_(pa.string())))

    @F.arrow_udf("array<array<string>>")
    def merge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield merged(texts)

    return df.withColumn(name, merge(F.col(sentences)))


def apply_phrases(df: DataFrame, key: str, sentences: str, phrases: DataFrame, name: str = "merged", fits: bool | None = None) -> DataFrame:
    """Merge listed pairs left to right without overlap into ``w1_w2`` tokens, in an array (sentences) of arrays (tokens).

    Phrases of checked size are sent to where the rows are, and more of them as files that are looked up there: nothing is exploded or
    shuffled. Only beyond the files' limit a filter of their hashes picks the few places that are checked against them, and a row's
    own phrases are joined to it by ``key``, which must then be unique.
    """
    phrases = materialise(phrases.select("w1", "w2", *[c for c in phrases.columns if c == "n12"]), "phrases")  # measured, then read
    if fits_broadcast(phrases.select("w1", "w2")) if fits is None else fits:
        return _merged_in_rows(df, sentences, phrases, name)
    files = mapped.ship(phrases, F.array("w1", "w2"), F.lit(0))
    return _merged_by_own(df, key, sentences, phrases, name) if files is None else _merged_beside(df, sentences, files, name)


def merge_tokens(tokens: DataFrame, phrases: DataFrame, key: str, *keep: str) -> DataFrame:
    """``apply_phrases`` on a token table.

    In a run of consecutive listed pairs every second one starts a merge, counted from the run's
    first token. The windows cover one sentence each and need a document's tokens in one
    partition: tokens of documents that were dealt by ``key`` are not shuffled again.
    """
    weight = "n12" if "n12" in phrases.columns else None
    listed = phrases.select(
        F.col("w1").alias("token"), F.col("w2").alias("next_token"), F.lit(True).alias("_pair"), *[weight] * bool(weight))
    flagged = lookup_join(tokens, listed, ["token", "next_token"], spread=[key, "sent", "pos"], weight=weight)
    by_doc = flagged.withColumn("_pair", F.coalesce("_pair", F.lit(False)))
    order = Window.partitionBy(key, "sent").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    last_free = F.coalesce(F.max(F.when(~F.col("_pair"), F.col("pos"))).over(upto), F.lit(-1))
    starts = F.col("_pair") & ((F.col("pos") - last_free) % 2 == 1)
    merged = by_doc.withColumn("_starts", starts)
    merged = merged.withColumn("_taken", F.coalesce(F.lag("_starts").over(order), F.lit(False)))
    token = F.when(F.col("_starts"), F.concat_ws("_", "token", "next_token")).otherwise(F.col("token"))
    return merged.filter(~F.col("_taken")).select(key, *keep, "sent", "pos", token.alias("token"))


def _count_cutoff(counts: DataFrame, max_words: int) -> int:
    """Smallest count a word needs to be among the ``max_words`` most frequent ones, ties included.

    Looks at the highest distinct counts only, at most ``max_words`` of them.
    """
    top = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_words")).orderBy(F.desc("n")).limit(max_words)
    before = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    needed = top.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    return needed.filter(F.col("_before") < max_words).agg(F.coalesce(F.min("n"), F.lit(0)).alias("n")).first()["n"]


def word_counts(df: DataFrame, words: str) -> DataFrame:
    """``(token, n)`` over all word lists, counted where the words are exploded."""
    tokens = df.select(F.explode_outer(words).alias("token")).filter(F.col("token").isNotNull())
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def build_vocab(df: DataFrame, words: str, max_words: int | None = None, min_count: int = 1) -> DataFrame:
    """Word vocabulary ``(token, n, token_id)``: by count descending, then token; ids from 4.

    With a size limit only words that can make it are sorted, not the long tail of rare ones.
    """
    counts = word_counts(df, words).filter(F.col("n") >= min_count)
    if max_words is not None:
        counts = materialise(counts, "word-counts")
        counts = counts.filter(F.col("n") >= _count_cutoff(counts, max_words))
    vocab = with_position(counts, F.desc("n"), "token", name="_rank")
    if max_words is not None:
        vocab = vocab.filter(F.col("_rank") < max_words)
    return vocab.select("token", "n", (F.col("_rank") + FIRST_WORD_ID).cast("int").alias("token_id"))


def _ids_in_rows(words: str, vocab: DataFrame) -> Column:
    listed = vocab.select("token", F.col("token_id").cast("int")).toArrow()  # of checked size
    share = vocab.sparkSession.sparkContext.broadcast(listed.combine_chunks())

    @F.arrow_udf("array<int>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, ids = (share.value.column(i).combine_chunks() for i in range(2))
        for texts in batches:
            found = ids.take(pc.index_in(texts.flatten().cast(tokens.type), value_set=tokens)).fill_null(UNKNOWN_ID)
            ends = np.concatenate([[0], np.cumsum(texts.value_lengths().fill_null(0).to_numpy())])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    return look_up(F.col(words))


def _ids_by_own(df: DataFrame, key: str, words: str, vocab: DataFrame) -> DataFrame:
    stored = materialise(vocab.select("token", F.col("token_id").cast("int"), "n"), "vocab")
    cut = count_cut(stored, "n")
    frequent = (F.col("n") >= cut) if cut is not None else F.lit(False)
    listed = stored.filter(frequent).select("token", "token_id").toArrow()  # of checked size
    share = df.sparkSession.sparkContext.broadcast(listed.combine_chunks())

    @F.arrow_udf("array<string>")
    def beyond(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = pa.concat_arrays(share.value.column(0).chunks or [pa.array([], pa.string())])
        for texts in batches:
            flat = texts.flatten().cast(tokens.type)
            rare = pc.index_in(flat, value_set=tokens).is_null()
            ends = np.concatenate([[0], np.cumsum(texts.value_lengths().fill_null(0).to_numpy())])
            upto = np.concatenate([[0], np.cumsum(rare.to_numpy(zero_copy_only=False))])
            yield pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), flat.filter(rare).cast(pa.string()))

    @F.arrow_udf("array<int>")
    def look_up(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tokens = pa.concat_arrays(share.value.column(0).chunks or [pa.array([], pa.string())])
        ids = pa.concat_arrays(share.value.column(1).chunks or [pa.array([], pa.int32())])
        for texts, own, own_ids in batches:
            flat = texts.flatten().cast(tokens.type)
            found = ids.take(pc.index_in(flat, value_set=tokens))
            # a word has one id, whichever row of the batch brought it along
            rest = own_ids.flatten().take(pc.index_in(flat, value_set=own.flatten().cast(tokens.type)))
            ends = np.concatenate([[0], np.cumsum(texts.value_lengths().fill_null(0).to_numpy())])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.coalesce(found, rest).fill_null(UNKNOWN_ID))

    rare = df.select(key, F.explode_outer(F.array_distinct(beyond(F.col(words)))).alias("token")).filter(F.col("token").isNotNull())
    own = rare.join(stored.filter(~frequent).select("token", "token_id").hint("merge"), "token")
    own = own.groupBy(key).agg(F.collect_list(F.struct("token", "token_id")).alias("_own"))
    return join_own(df.select(key, words), key, own).select(key, look_up(words, "_own.token", "_own.token_id").alias("ids"))


def encode_tokens(df: DataFrame, key: str, words: str, vocab: DataFrame, fits: bool | None = None) -> DataFrame:
    """Token ids per document in word order, unknown words as 3, without start and end ids; a null word list gives no ids.

    A vocabulary of checked size goes to where the rows are, and nothing is exploded or shuffled. Beyond that its most frequent words go
    there, and a row's other words, few of all, are joined to it by ``key``, which must then be unique.
    """
    if fits_broadcast(vocab.select("token", "token_id")) if fits is None else fits:
        return df.select(key, _ids_in_rows(words, vocab).alias("ids"))
    return _ids_by_own(df, key, words, vocab)
