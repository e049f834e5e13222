"""PII by bootstrapped contextual extraction, in built-in expressions and joins only.

Base finds are e-mail addresses, IP addresses, card numbers that pass the Luhn check and telephone
numbers. They seed the bootstrap. A find's lexical patterns are the word before it, the two words before it and
the two words behind it; tokens with digits or "@" elsewhere are instances of the patterns they stand in. On the graph
of distinct (pattern, instance) edges rounds go to and fro. A pattern's evidence is the belief in its instances,
summed, and its score their mean; with evidence of ``MIN_SEEDS`` and a score of ``MIN_SCORE`` it is trusted. A seed
has belief 1; another instance the chance that one of the trusted patterns it stands in is right, leaving out the
pattern under judgement; a token in the form of a base kind that failed this kind's check has belief 0 and is never
found. What earlier rounds have come to believe is thus evidence for patterns that hold no seed.
After the rounds, tokens in a trusted pattern are added as kind ``found``.

Edges and scores are grouped sums with partial aggregation, so a pattern that a third of the rows
share is no hot task, and joins are left to the optimiser, which splits large keys. Regular expressions run
over long junk in linear time: a run is entered at its first character only and not given back.

A null text counts as empty, with no spans; very long texts are read whole. Offsets are code points, end exclusive.
Repeated rows get equal spans; their edges count once. Patterns of equal score are trusted alike. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.binding import let
from presswork.session import materialise

KINDS = ("email", "ip", "card", "phone", "found")
ROUNDS = 4
MIN_SEEDS = 3
MIN_SCORE = 0.6
CONTEXT = 48  # characters before and behind a find in which its patterns are looked for

# \G lets a find begin where the last one ended, inside a run whose first part was taken.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TOKEN = r"(?<![^\s\"'<>(),;|])[^\s\"'<>(),;|0-9@]*+[0-9@][^\s\"'<>(),;|]*+"
_IP_VALID = r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?){3}$"

# Tokens in the form of a base kind that are none, as they failed its check.
_REFUTED = r"^(?:[0-9][0-9-]{12,}[0-9]|[0-9]+(?:\.[0-9]+){3}|\+[0-9().-]+)\.*$"

SPAN = "struct<start: int, kind: int, end: int, body: string, patterns: array<string>>"
BLOCK = 512


_BEFORE = r"(?:(?<!\S)(\S+)\s+)?(?<!\S)(\S+)\s*[\"'(<]?$"
_BEHIND = r"^[\"')>.,;:!?]*\s+(\S+\s+\S+)"


def patterns_of(before: Column, behind: Column) -> Column:
    """The patterns of a find from the text on either side of it up to its neighbours: one word before, two words
    before, two words behind, lower-cased and with digits masked. A pattern without its words is left out."""

    def plain(part: Column) -> Column:
        return F.regexp_replace(F.lower(part), "[0-9]", "0")

    near = F.substring(before, -CONTEXT, CONTEXT)
    first, last = (F.regexp_extract(near, _BEFORE, i) for i in (1, 2))
    after = F.regexp_extract(F.substring(behind, 1, CONTEXT), _BEHIND, 1)
    given = F.array(F.when(last != "", F.concat(F.lit("1 "), plain(last))),
                    F.when(first != "", F.concat(F.lit("2 "), plain(first), F.lit(" "), plain(last))),
                    F.when(after != "", F.concat(F.lit("r "), plain(after))))
    return F.filter(given, lambda p: p.isNotNull())


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Array of spans of all matches, leftmost and not overlapping, in order.

    The engine gives matches and, by splitting, the text between them; both come from the same
    search, so their lengths add up to the places. The running sum goes block by block, as an
    array that grows by one element at a time would be copied as often.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sides = F.zip_with(F.slice(gaps, 1, F.size(found)), F.slice(gaps, 2, F.size(found)), lambda g, h: F.struct(
        F.char_length(g).alias("g"), patterns_of(g, h).alias("p")))
    parts = F.zip_with(found, sides, lambda m, s: F.struct(m.alias("m"), s["g"].alias("g"), s["p"].alias("p")))
    spans = f"array<{SPAN}>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.char_length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("body"), x["p"].alias("patterns"))
        return F.struct(end.alias("at"), F.array_append(acc["done"], span).alias("done"))

    def block(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), F.array().cast(spans).alias("done")), step)
        return let(inner, lambda i: F.struct(i["at"].alias("at"), F.array_append(acc["done"], i["done"]).alias("done")))

    def summed(all_parts: Column) -> Column:
        count = F.ceil(F.size(all_parts) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(all_parts, b * BLOCK + 1, BLOCK))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("done"))
        return F.aggregate(blocks, start, block, lambda a: F.flatten(a["done"]))

    return F.when(F.size(found) > 0, let(parts, summed)).otherwise(F.array().cast(spans))


def digits_of(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))

    def value(n: Column, i: Column) -> Column:
        twice = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(numbers, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """Sorted spans of the base kinds, as an array of ``SPAN``."""
    n_digits = lambda s: F.char_length(digits_of(s["body"]))
    card = F.filter(matches(text, _CARD, 2), lambda s: n_digits(s).between(14, 19))
    return F.array_sort(F.concat(
        matches(text, _EMAIL, 0),
        F.filter(matches(text, _IP, 1), lambda s: F.rlike(s["body"], F.lit(_IP_VALID))),
        F.filter(card, lambda s: luhn(digits_of(s["body"]))),
        F.filter(matches(text, _PHONE, 3), lambda s: n_digits(s).between(10, 15)),
    ))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _finds(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored narrow rows: key, ``_row``, ``base`` spans and ``tokens``: all tokens with digits or "@"."""
    t = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    narrow = t.select(key, base_spans(F.col("_text")).alias("base"), matches(F.col("_text"), _TOKEN, 4).alias("tokens"))
    return materialise(narrow.withColumn("_row", F.monotonically_increasing_id()), "finds")


def _places(rows: DataFrame) -> DataFrame:
    """Stored rows (_row, start, kind, end, body, patterns): base finds, and tokens that touch none of them."""
    spans = rows.select("_row", F.explode(F.concat("base", "tokens")).alias("s")).select("_row", "s.*")
    # two running aggregates: a frame that looks ahead would be summed anew for every row
    onward = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    base_end, base_start = F.when(F.col("kind") < 4, F.col("end")), F.when(F.col("kind") < 4, F.col("start"))
    before, after = F.max(base_end).over(onward), F.min(base_start).over(backward)
    marked = spans.withColumn("_before", before).withColumn("_after", after)
    free = (F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.coalesce("_after", F.col("end")) >= F.col("end"))
    return materialise(marked.where((F.col("kind") < 4) | free).where("size(patterns) > 0").drop("_before", "_after"), "places")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """(pattern, evidence, score) of the patterns trusted in the end, from distinct rows (pattern, instance, seed)."""
    edges = edges.withColumn("refuted", ~F.col("seed") & F.rlike("instance", F.lit(_REFUTED)))
    told = edges.withColumn("belief", F.col("seed").cast("double"))
    for number in range(rounds):
        scores = told.groupBy("pattern").agg(F.sum("belief").alias("evidence"), F.avg("belief").alias("score"))
        # sums in another order may differ in the last bits
        near = 1e-9
        trusted = materialise(scores.where((F.col("evidence") >= min_seeds - near) & (F.col("score") >= min_score - near)), "trusted")
        if number == rounds - 1:
            return trusted
        # doubt: log of the chance that a pattern, or all of an instance's patterns, are wrong
        doubts = trusted.select("pattern", F.log(1 - F.least("score", F.lit(0.999))).alias("own"))
        total = edges.join(doubts, "pattern").groupBy("instance").agg(F.sum("own").alias("doubt"))
        told = edges.join(total, "instance", "left").join(doubts, "pattern", "left").select(
            "pattern", "instance", "seed",
            F.when(F.col("seed"), 1.0).when(F.col("refuted"), 0.0).otherwise(
                F.greatest(1 - F.exp(F.coalesce("doubt", F.lit(0.0)) - F.coalesce("own", F.lit(0.0))), F.lit(0.0))).alias("belief"))
    return told


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
             min_score: float = MIN_SCORE) -> DataFrame:
    """Per row: key, counts of the base kinds, ``n_found``, ``base`` and ``found`` spans (arrays), in code points."""
    rows = _finds(docs, key, text)
    places = _places(rows)
    standing = places.select("_row", "start", "kind", "end", "body", F.explode("patterns").alias("pattern"))
    edges = materialise(standing.groupBy("pattern", F.col("body").alias("instance")).agg(
        F.max(F.col("kind") < 4).alias("seed")), "graph")
    good = score_patterns(edges, rounds, min_seeds, min_score).select("pattern")
    spans = standing.where("kind = 4").where(~F.rlike("body", F.lit(_REFUTED))).join(good, "pattern").select("_row", "start", "kind", "end", "body").distinct()
    found = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
        "start", "kind", "end", "body", F.array().cast("array<string>").alias("patterns")))).alias("found"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    none = F.array().cast(f"array<{SPAN}>")
    return rows.join(found, "_row", "left").select(
        key, *[count(i).alias(f"n_{name}") for i, name in enumerate(KINDS[:4])],
        F.size(F.coalesce("found", none)).cast("long").alias("n_found"), "base", F.coalesce("found", none).alias("found"))
