"""Preprocessing, vocabulary, token ids and text exploration over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import labels, text as txt
from presswork.operators import corpus, explore, segment, sentences as ends, tagging, words
from presswork.plans import sql_text as s
from presswork.plans.registry import query, table, text_table
from presswork.session import materialise

MAX_LENGTH = 256


def _docs(spark, sf_dir, *columns):
    return text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", *columns)


@query("strip_chars", sql=f"SELECT doc_id, {s.stripped('text')} AS stripped FROM documents")
def strip_chars(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", txt.strip_chars(F.col("text")).alias("stripped"))


@query("split_sentences", sql=f"""
WITH l AS (SELECT doc_id, {s.sents('text')} AS ss FROM documents)
SELECT doc_id, generate_subscripts(ss, 1) - 1 AS sent, unnest(ss) AS sentence FROM l""")
def split_sentences(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(
        "doc_id", F.posexplode_outer(txt.sentences(F.col("text"))).alias("sent", "sentence"))
    return rows.filter(F.col("sentence").isNotNull())


_TYPE = r"lower(regexp_replace({}, '\.+\z', ''))"


def _term(k: str, x: str) -> str:
    return f"CASE WHEN {k} = 0 THEN 0.0::double ELSE {k} * ln({x}) END"


def _likely(k: str, n: str, x: str) -> str:
    return f"({_term(f'({k})', x)} + {_term(f'({n} - ({k}))', f'1 - {x}')})"


SENTENCE_MODEL = rf"""
lines AS (
  SELECT doc_id, unnest(ls) AS words, generate_subscripts(ls, 1) AS line FROM (
    SELECT doc_id, list_transform(string_split_regex({s.stripped('text')}, '
+'),
      lambda l: list_filter(string_split_regex(l, '[{s.SP}]+'), lambda t: t <> '')) AS ls FROM documents)),
marks AS MATERIALIZED (
  SELECT *, {_TYPE.format('token')} AS type, ends_with(token, '.') AS dotted, {_TYPE.format('follows')} AS follower FROM (
    SELECT *, lead(token) OVER (PARTITION BY doc_id, line ORDER BY pos) AS follows FROM (
      SELECT doc_id, line, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM lines))),
types AS MATERIALIZED (SELECT type, count(*) FILTER (dotted) AS n_dotted, count(*) FILTER (NOT dotted) AS n_plain FROM marks GROUP BY 1),
all_types AS MATERIALIZED (SELECT sum(n_dotted)::double / sum(n_dotted + n_plain)::double AS share, sum(n_dotted + n_plain)::bigint AS n FROM types),
short AS MATERIALIZED (
  SELECT type, n_dotted, n_plain, score FROM (
    SELECT *, -2 * ({_term('n_dotted', 'share')} + {_term('n_plain', '1 - share')} - n_dotted * ln(0.99::double) - n_plain * ln(1 - 0.99::double))
              * exp(-len(replace(type, '.', ''))) * (len(type) - len(replace(type, '.', '')) + 1)
              * pow(len(replace(type, '.', ''))::double, -n_plain) AS score
    FROM types, all_types WHERE n_dotted > 0 AND regexp_matches(type, '\p{{L}}')) WHERE score >= {ends.MIN_ABBREVIATION}),
after_ends AS MATERIALIZED (
  SELECT follower AS type, count(*) AS n_after FROM marks
  WHERE dotted AND regexp_matches(follower, '\p{{L}}') AND regexp_matches(type, '\p{{L}}') AND type NOT IN (SELECT type FROM short) GROUP BY 1),
first_words AS MATERIALIZED (
  SELECT type, n_after, own AS n, score FROM (
    SELECT *, 2 * ({_likely('n_after', 'e', '(n_after / e)')} + {_likely('own - n_after', '(n - e)', '((own - n_after) / (n - e))')}
                   - {_likely('n_after', 'e', '(own / n)')} - {_likely('own - n_after', '(n - e)', '(own / n)')}) AS score
    FROM (SELECT type, n_after, n_dotted + n_plain AS own FROM after_ends JOIN types USING (type)), (SELECT n FROM all_types),
         (SELECT sum(n_after)::bigint AS e FROM after_ends))
  WHERE score >= {ends.MIN_STARTER} AND n_after / e > own / n)
"""


def _line_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", ends.line_tokens(F.col("text")).alias("lines"))


@query("learn_abbreviations", sql=f"""
WITH {SENTENCE_MODEL}
SELECT 'abbreviation' AS kind, type, n_dotted AS n_first, n_plain AS n_second, round(score, 6) AS score FROM short
UNION ALL SELECT 'starter', type, n_after, n, round(score, 4) FROM first_words""")
def learn_abbreviations(spark, sf_dir):
    """Abbreviations with their counts with and without a dot; starters with their counts after a sentence's end and in all."""
    short, first = ends.learn(_line_tokens(spark, sf_dir), "lines")
    listed = short.select(F.lit("abbreviation").alias("kind"), "type", F.col("n_dotted").alias("n_first"), F.col("n_plain").alias("n_second"),
                          F.round("score", 6).alias("score"))
    return listed.unionByName(first.select(
        F.lit("starter").alias("kind"), "type", F.col("n_after").alias("n_first"), F.col("n").alias("n_second"), F.round("score", 4).alias("score")))


@query("split_sentences_learned", sql=rf"""
WITH {SENTENCE_MODEL},
ended AS (
  SELECT *, follows IS NULL OR (dotted AND NOT (type IN (SELECT type FROM short) AND NOT (
    regexp_matches(follows, '\A\p{{Lu}}') AND follower IN (SELECT type FROM first_words)))) AS last
  FROM marks),
numbered AS (
  SELECT *, coalesce(sum(last::int) OVER (PARTITION BY doc_id ORDER BY line, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM ended)
SELECT doc_id, sent::int AS sent, string_agg(token, ' ' ORDER BY line, pos) AS sentence FROM numbered GROUP BY 1, 2""")
def split_sentences_learned(spark, sf_dir):
    lines = _line_tokens(spark, sf_dir)
    found = ends.split_learned(lines, "doc_id", "lines", *ends.learn(lines, "lines"))
    rows = found.select("doc_id", F.posexplode_outer("sentences").alias("sent", "sentence"))
    return rows.filter(F.col("sentence").isNotNull())


@query("tokenize_words", sql=f"WITH {s.TOKENS} SELECT doc_id, sent, pos, token FROM tokens")
def tokenize_words(spark, sf_dir):
    return words.token_table(_docs(spark, sf_dir), "doc_id", "text").drop("next_token")


PHRASES = f"""
{s.TOKENS},
pairs AS (
  SELECT token AS w1, lead(token) OVER (PARTITION BY doc_id, sent ORDER BY pos) AS w2 FROM tokens),
singles AS MATERIALIZED (SELECT token, count(*) AS n FROM tokens GROUP BY 1),
total AS MATERIALIZED (SELECT sum(n)::double AS n FROM singles),
pair_counts AS MATERIALIZED (SELECT w1, w2, count(*) AS n12 FROM pairs WHERE w2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5),
scored AS (
  SELECT w1, w2, n12, a.n AS n1, b.n AS n2,
         (n12 - 5.0::double) * total.n / (a.n * b.n) AS score
  FROM pair_counts JOIN singles a ON w1 = a.token JOIN singles b ON w2 = b.token CROSS JOIN total),
phrases AS MATERIALIZED (SELECT * FROM scored WHERE score > 10)
"""


def _phrases(spark, sf_dir):
    return words.learn_phrases(words.token_table(_docs(spark, sf_dir), "doc_id", "text"), threshold=10.0)


@query("learn_phrases", sql=f"WITH {PHRASES} SELECT w1, w2, n12, n1, n2, score FROM phrases")
def learn_phrases(spark, sf_dir):
    return _phrases(spark, sf_dir)


@query("apply_phrases", sql=f"""
WITH {PHRASES},
nexts AS MATERIALIZED (
  SELECT *, lead(token) OVER (PARTITION BY doc_id, sent ORDER BY pos) AS next_token FROM tokens),
hits AS MATERIALIZED (
  SELECT n.*, row_number() OVER (PARTITION BY doc_id, sent ORDER BY pos) AS k
  FROM nexts n JOIN phrases p ON n.token = p.w1 AND n.next_token = p.w2),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, sent, pos - k ORDER BY pos) AS in_run FROM hits),
starts AS MATERIALIZED (SELECT doc_id, sent, pos FROM runs WHERE in_run % 2 = 1)
SELECT doc_id, count(n.pos)::int AS n_tokens, count(starts.pos)::int AS n_merged,
       coalesce(string_agg(CASE WHEN starts.pos IS NULL THEN n.token ELSE n.token || '_' || n.next_token END, ' ' ORDER BY n.sent, n.pos), '') AS merged
FROM documents LEFT JOIN (
  SELECT n.* FROM nexts n LEFT JOIN starts b ON b.doc_id = n.doc_id AND b.sent = n.sent AND b.pos = n.pos - 1 WHERE b.pos IS NULL) n USING (doc_id)
LEFT JOIN starts USING (doc_id, sent, pos) GROUP BY doc_id""")
def apply_phrases(spark, sf_dir):
    """One row per document: tokens after merging, how many are merged, and the merged text."""
    sentences = _docs(spark, sf_dir).select("doc_id", txt.sentence_words(F.col("text")).alias("sentences"))
    merged = words.apply_phrases(sentences, "doc_id", "sentences", _phrases(spark, sf_dir))
    flat = merged.select("doc_id", F.size(F.flatten("sentences")).alias("before"), F.flatten("merged").alias("tokens"))
    return flat.select("doc_id", F.size("tokens").alias("n_tokens"), (F.col("before") - F.size("tokens")).alias("n_merged"),
                       F.array_join("tokens", " ").alias("merged"))


def _lexicon_rounds(rounds: int) -> str:
    """CTEs of ``segment.learn_lexicon``, from the n-grams with their counts."""
    made = ["e0 AS (SELECT *, n AS expected FROM ngrams)"]
    for r in range(rounds):
        made.append(f"""
t{r} AS (SELECT sum(expected)::double AS total FROM e{r}),
v{r} AS (
  SELECT word, sum(v ORDER BY i) AS rival FROM (
    SELECT s.word, s.i, a.expected::double * b.expected AS v FROM splits s JOIN e{r} a ON a.word = s.head JOIN e{r} b ON b.word = s.rest)
  GROUP BY word),
j{r} AS MATERIALIZED (
  SELECT word, length, n, chance, floor(n * chance)::bigint AS used FROM (
    SELECT e.*, CASE WHEN length = 1 THEN 1.0::double WHEN expected * total + rival > 0
                     THEN (expected * total) / (expected * total + rival) ELSE 0.0 END AS chance
    FROM e{r} e CROSS JOIN t{r} LEFT JOIN v{r} USING (word))),
i{r} AS (
  SELECT word, max(used) AS inside FROM (
    SELECT s.head AS word, 'head' AS side, sum(used)::bigint AS used FROM splits s JOIN j{r} USING (word) WHERE s.i = length - 1 GROUP BY 1
    UNION ALL
    SELECT s.rest, 'rest', sum(used)::bigint FROM splits s JOIN j{r} USING (word) WHERE s.i = 1 GROUP BY 1) GROUP BY 1),
e{r + 1} AS MATERIALIZED (
  SELECT word, length, n, floor((n - coalesce(inside, 0)) * chance)::bigint AS expected FROM j{r} LEFT JOIN i{r} USING (word))""")
    return ",".join(made)


LEARNED = rf"""
{s.TOKENS},
runs AS (
  SELECT token AS w1, lead(token, 1) OVER o AS w2, lead(token, 2) OVER o AS w3, lead(token, 3) OVER o AS w4
  FROM tokens WINDOW o AS (PARTITION BY doc_id, sent ORDER BY pos)),
grams AS (
  SELECT [w1] AS g FROM runs UNION ALL SELECT [w1, w2] FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL UNION ALL SELECT [w1, w2, w3, w4] FROM runs WHERE w4 IS NOT NULL),
ngrams AS MATERIALIZED (
  SELECT array_to_string(g, ' ') AS word, g, len(g)::int AS length, count(*) AS n FROM grams GROUP BY g
  HAVING len(g) = 1 OR (count(*) >= {segment.MIN_COUNT} AND len(list_filter(g, lambda t: NOT regexp_matches(t, '\p{{L}}'))) = 0)),
splits AS MATERIALIZED (
  SELECT word, i, array_to_string(g[1:i], ' ') AS head, array_to_string(g[i + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, length)) AS i FROM ngrams WHERE length > 1)),
{_lexicon_rounds(segment.ROUNDS)},
uses AS (
  SELECT word, length, n, CASE WHEN length = 1 THEN greatest(expected, 1) ELSE expected END AS expected FROM e{segment.ROUNDS}
  WHERE length = 1 OR expected > 0),
lexicon_total AS MATERIALIZED (SELECT sum(expected)::double AS total FROM uses),
learned AS MATERIALIZED (SELECT word, length, n, expected, round(1000 * ln(total / expected))::bigint AS cost FROM uses, lexicon_total)
"""


def _sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", txt.sentence_words(F.col("text")).alias("sentences"))


@query("learn_lexicon", sql=f"WITH {LEARNED} SELECT word, length, n, expected, cost FROM learned")
def learn_lexicon(spark, sf_dir):
    return segment.learn_lexicon(_sentences(spark, sf_dir), "sentences")


# the cheapest path, one token after another: c1 is the least cost up to the last token, c2 the one before that, and so on
SEGMENTED = f"""
WITH RECURSIVE {LEARNED},
steps AS MATERIALIZED (
  SELECT t.doc_id, t.sent, t.pos, coalesce(a.cost, round(1000 * ln(total))::bigint) AS k1, b.cost AS k2, c.cost AS k3, d.cost AS k4
  FROM (SELECT *, lag(token, 1) OVER o AS p1, lag(token, 2) OVER o AS p2, lag(token, 3) OVER o AS p3 FROM tokens
        WINDOW o AS (PARTITION BY doc_id, sent ORDER BY pos)) t CROSS JOIN lexicon_total
  LEFT JOIN learned a ON a.word = token LEFT JOIN learned b ON b.word = p1 || ' ' || token
  LEFT JOIN learned c ON c.word = p2 || ' ' || p1 || ' ' || token LEFT JOIN learned d ON d.word = p3 || ' ' || p2 || ' ' || p1 || ' ' || token),
walk AS (
  SELECT doc_id, sent, 0::bigint AS place, 0::bigint AS c1, NULL::bigint AS c2, NULL::bigint AS c3, NULL::bigint AS c4 FROM tokens GROUP BY 1, 2
  UNION ALL
  SELECT w.doc_id, w.sent, place + 1, least(c1 + k1, c2 + k2, c3 + k3, c4 + k4), c1, c2, c3
  FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.sent = w.sent AND s.pos = w.place),
ends AS (SELECT doc_id, sent, arg_max(c1, place) AS cost, max(place) AS n FROM walk GROUP BY 1, 2)
SELECT doc_id, coalesce(sum(n), 0)::bigint AS n_syllables, coalesce(sum(cost), 0)::bigint AS cost
FROM documents LEFT JOIN ends USING (doc_id) GROUP BY doc_id"""


@query("segment_words", sql=SEGMENTED)
def segment_words(spark, sf_dir):
    """Tokens of each document and the cost of its best segmentation with the learned lexicon, taken from the words chosen."""
    sentences = materialise(_sentences(spark, sf_dir), "sentences")  # read for pairs, runs and words
    lexicon = materialise(segment.learn_lexicon(sentences, "sentences"), "lexicon")
    found = segment.segment(sentences, "doc_id", "sentences", lexicon)
    return found.select("doc_id", F.size(F.flatten("sentences")).cast("long").alias("n_syllables"), F.col("segmented.cost").alias("cost"))


# the lexicon of the registered queries: words of the benchmark texts, short ones tagged as foreign
LEXICON = rf"""
lexicon AS (
  SELECT token, CASE WHEN length(token) <= 2 THEN 'X' ELSE 'N' END AS tag
  FROM (SELECT DISTINCT unnest(string_split_regex(text, '[^\p{{L}}]+')) AS token FROM benchmark) WHERE token <> ''),
tagged AS (
  SELECT t.*, coalesce(x.tag, CASE WHEN regexp_matches(t.token, '\p{{L}}') THEN 'N'
                                   WHEN regexp_matches(t.token, '\p{{N}}') THEN 'M' ELSE 'CH' END) AS tag
  FROM tokens t LEFT JOIN lexicon x USING (token)),
dropped AS (SELECT * FROM tagged WHERE tag NOT IN ('M', 'X', 'CH') AND token NOT IN ('''', ','))
"""


def _lexicon(spark, sf_dir):
    token = F.explode(F.split("text", r"[^\p{L}]+")).alias("token")
    return (
        table(spark, sf_dir, "benchmark").select(token).filter(F.col("token") != "").distinct()
        .withColumn("tag", F.when(F.length("token") <= 2, "X").otherwise("N"))
    )


def _dropped(spark, sf_dir):
    tokens = words.token_table(_docs(spark, sf_dir), "doc_id", "text")
    return words.drop_tags(words.tag_tokens(tokens, _lexicon(spark, sf_dir), "doc_id"))


@query("drop_tags", sql=f"WITH {s.TOKENS}, {LEXICON} SELECT doc_id, sent, pos, token, tag FROM dropped")
def drop_tags(spark, sf_dir):
    return _dropped(spark, sf_dir).select("doc_id", "sent", "pos", "token", "tag")


# the tagged texts to learn from are those of the benchmark: short words are foreign, capitals inside a sentence are names
FORM_TAG = (r"CASE WHEN NOT regexp_matches({0}, '\p{{L}}') THEN CASE WHEN regexp_matches({0}, '\p{{N}}') THEN 'M' ELSE 'CH' END "
            r"WHEN {1} > 0 AND regexp_matches({0}, '\A\p{{Lu}}') THEN 'Np' WHEN length({0}) <= 2 THEN 'X' ELSE 'N' END")


def _chance(share: str) -> str:
    return f"round(-1000 * ln({share}))::bigint"


TAGGER = f"""
{s.TOKENS},
tagged AS MATERIALIZED (
  SELECT lower(token) AS word, pos, {FORM_TAG.format('token', 'pos')} AS tag, {FORM_TAG.format('next_token', '(pos + 1)')} AS follower, next_token
  FROM (SELECT *, lead(token) OVER (PARTITION BY item_id, sent ORDER BY pos) AS next_token FROM (
    SELECT item_id, sent, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS pos FROM (
      SELECT item_id, unnest(ss) AS ws, generate_subscripts(ss, 1) AS sent FROM (SELECT item_id, {s.sent_toks('text')} AS ss FROM benchmark))))),
tags AS MATERIALIZED (SELECT tag, count(*)::double AS n, (SELECT count(DISTINCT tag) FROM tagged) AS k FROM tagged GROUP BY 1),
pairs AS (
  SELECT tag, follower, count(*) AS n FROM tagged WHERE next_token IS NOT NULL GROUP BY ALL
  UNION ALL SELECT '', tag, count(*) FROM tagged WHERE pos = 0 GROUP BY ALL),
sums AS (SELECT tag, sum(n)::double AS n FROM pairs GROUP BY 1),
steps AS (
  SELECT a.tag, list({_chance('(coalesce(p.n, 0) + 1) / (coalesce(sums.n, 0) + b.k)')} ORDER BY b.tag) AS costs
  FROM (SELECT tag FROM tags UNION ALL SELECT '') a CROSS JOIN tags b
  LEFT JOIN pairs p ON p.tag = a.tag AND p.follower = b.tag LEFT JOIN sums ON sums.tag = a.tag GROUP BY a.tag),
matrix AS MATERIALIZED (
  SELECT list(costs ORDER BY tag) FILTER (tag <> '') AS moves, any_value(costs) FILTER (tag = '') AS opening FROM steps),
known AS MATERIALIZED (
  SELECT word, list(CASE WHEN m IS NOT NULL THEN {_chance('m / n')} END ORDER BY tag) AS costs
  FROM (SELECT DISTINCT word FROM tagged) CROSS JOIN tags LEFT JOIN (SELECT word, tag, count(*) AS m FROM tagged GROUP BY ALL) USING (word, tag) GROUP BY 1),
endings AS MATERIALIZED (
  SELECT ending, list({_chance('(coalesce(m, 0) + 1) / (n + (SELECT count(DISTINCT right(word, 2)) FROM tagged))')} ORDER BY tag) AS costs
  FROM (SELECT DISTINCT right(word, 2) AS ending FROM tagged UNION ALL SELECT NULL) CROSS JOIN tags
  LEFT JOIN (SELECT right(word, 2) AS ending, tag, count(*) AS m FROM tagged GROUP BY ALL) USING (ending, tag) GROUP BY 1)
"""


@query("tag_sequences", sql=f"""
WITH RECURSIVE {TAGGER},
places AS MATERIALIZED (
  SELECT doc_id, sent, pos, coalesce(w.costs, e.costs, (SELECT costs FROM endings WHERE ending IS NULL)) AS own
  FROM tokens LEFT JOIN known w ON w.word = lower(token) LEFT JOIN endings e ON e.ending = right(lower(token), 2)),
walk AS (
  SELECT doc_id, sent, 0::bigint AS place, list_transform(own, lambda c, j: c + opening[j]) AS costs FROM places CROSS JOIN matrix WHERE pos = 0
  UNION ALL
  SELECT w.doc_id, w.sent, place + 1, list_transform(p.own, lambda c, j: c + list_min(list_transform(w.costs, lambda o, i: o + moves[i][j])))
  FROM walk w JOIN places p ON p.doc_id = w.doc_id AND p.sent = w.sent AND p.pos = w.place + 1 CROSS JOIN matrix),
last AS (SELECT doc_id, sent, list_min(arg_max(costs, place)) AS cost, max(place) + 1 AS n FROM walk GROUP BY 1, 2)
SELECT doc_id, coalesce(sum(n), 0)::bigint AS n_tokens, coalesce(sum(cost), 0)::bigint AS cost
FROM documents LEFT JOIN last USING (doc_id) GROUP BY doc_id""")
def tag_sequences(spark, sf_dir):
    """Tokens of each document and the cost of its best tags, which the benchmark's texts taught; added up along the tags chosen."""
    items = words.token_table(table(spark, sf_dir, "benchmark"), "item_id", "text")

    def tag(token, at):
        named = (at > 0) & token.rlike(r"\A\p{Lu}")
        return F.when(~token.rlike(txt.LETTER), txt.rule_tag(token)).when(named, "Np").when(F.length(token) <= 2, "X").otherwise("N")

    follower = F.when(F.col("next_token").isNotNull(), tag(F.col("next_token"), F.col("pos") + 1))
    model = tagging.learn_tagger(items.select(
        "token", tag(F.col("token"), F.col("pos")).alias("tag"), follower.alias("next_tag"), (F.col("pos") == 0).alias("first")))
    found = tagging.tag_sequences(_sentences(spark, sf_dir), "doc_id", "sentences", model)
    return found.select("doc_id", F.coalesce(F.size(F.flatten("tagged.tags")), F.lit(0)).cast("long").alias("n_tokens"),
                        F.coalesce("tagged.cost", F.lit(0)).cast("long").alias("cost"))


@query("lower_tokens", sql=f"WITH {s.TOKENS}, {LEXICON} SELECT doc_id, sent, pos, lower(token) AS word FROM dropped")
def lower_tokens(spark, sf_dir):
    return _dropped(spark, sf_dir).select("doc_id", "sent", "pos", F.lower("token").alias("word"))


@query("preprocess_text", sql=f"SELECT doc_id, {s.processed('text')} AS processed_content, lang AS category FROM documents")
def preprocess_text(spark, sf_dir):
    docs = _docs(spark, sf_dir, F.col("lang").alias("category"))
    return words.preprocess(docs, "doc_id", "text", "category")


PROCESSED_WITH_TABLES = f"""
WITH {PHRASES},
nexts AS MATERIALIZED (
  SELECT *, lead(token) OVER (PARTITION BY doc_id, sent ORDER BY pos) AS next_token FROM tokens),
hits AS MATERIALIZED (
  SELECT n.*, row_number() OVER (PARTITION BY doc_id, sent ORDER BY pos) AS k
  FROM nexts n JOIN phrases p ON n.token = p.w1 AND n.next_token = p.w2),
starts AS MATERIALIZED (
  SELECT doc_id, sent, pos FROM hits
  QUALIFY row_number() OVER (PARTITION BY doc_id, sent, pos - k ORDER BY pos) % 2 = 1),
merged AS (
  SELECT n.doc_id, n.sent, n.pos,
         CASE WHEN a.pos IS NULL THEN n.token ELSE n.token || '_' || n.next_token END AS token
  FROM nexts n
  LEFT JOIN starts a ON a.doc_id = n.doc_id AND a.sent = n.sent AND a.pos = n.pos
  LEFT JOIN starts b ON b.doc_id = n.doc_id AND b.sent = n.sent AND b.pos = n.pos - 1
  WHERE b.pos IS NULL),
{LEXICON.replace('FROM tokens t', 'FROM merged t')}
SELECT d.doc_id, coalesce(string_agg(lower(x.token), ' ' ORDER BY sent, pos), '') AS processed_content
FROM documents d LEFT JOIN dropped x ON x.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("preprocess_with_tables", sql=PROCESSED_WITH_TABLES)
def preprocess_with_tables(spark, sf_dir):
    return words.preprocess_with_tables(
        _docs(spark, sf_dir), "doc_id", "text", _phrases(spark, sf_dir), _lexicon(spark, sf_dir))


@query("vocab_of_processed", sql=f"""
SELECT token, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, token) + 3)::int AS token_id
FROM (SELECT unnest(string_split(processed_content, ' ')) AS token FROM ({PROCESSED_WITH_TABLES})) WHERE token <> '' GROUP BY 1""")
def vocab_of_processed(spark, sf_dir):
    """Vocabulary over texts with compound words joined and tagged words dropped, as models are fed."""
    processed = preprocess_with_tables(spark, sf_dir)
    listed = processed.select(F.filter(F.split("processed_content", " "), lambda w: w != "").alias("words"))
    return words.build_vocab(listed, "words")


@query("preprocess_quality", sql=rf"""
WITH l AS (SELECT doc_id, {s.sent_toks('text')} AS ss FROM documents),
k AS (
  SELECT doc_id, ss, list_transform(ss, lambda w: len(list_filter(w, lambda t: regexp_matches(t, '\p{{L}}')))) AS ks FROM l)
SELECT doc_id, len(ss)::int AS n_sentences, len(list_filter(ks, lambda n: n = 0))::int AS n_dropped_sentences,
       len(flatten(ss))::int AS n_tokens, coalesce(list_sum(ks), 0)::int AS n_kept FROM k""")
def preprocess_quality(spark, sf_dir):
    return words.preprocess_quality(_docs(spark, sf_dir), "doc_id", "text")


def kept_docs(spark, sf_dir, *columns):
    return _docs(spark, sf_dir, *columns).select("doc_id", txt.kept_words(F.col("text")).alias("words"), *columns)


KEPT = f"kept AS (SELECT doc_id, lang, {s.kept('text')} AS words FROM documents)"
VOCAB = f"""
{KEPT},
counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(words) AS token FROM kept) GROUP BY 1),
vocab AS (
  SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 3)::int AS token_id FROM counts),
exploded AS (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM kept),
coded AS (
  SELECT doc_id, list(coalesce(token_id, 3) ORDER BY pos) AS ids FROM exploded LEFT JOIN vocab USING (token) GROUP BY 1),
encoded AS (SELECT k.doc_id, coalesce(ids, []::int[]) AS ids FROM kept k LEFT JOIN coded USING (doc_id))
"""


def _vocab(spark, sf_dir):
    return words.build_vocab(kept_docs(spark, sf_dir), "words")


def _encoded(spark, sf_dir):
    return words.encode_tokens(kept_docs(spark, sf_dir), "doc_id", "words", _vocab(spark, sf_dir))


def _spaced(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


@query("build_vocab", sql=f"WITH {VOCAB} SELECT token, n, token_id FROM vocab")
def build_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)


@query("encode_tokens", sql=f"""
WITH {VOCAB} SELECT doc_id, array_to_string([0] || ids || [2], ' ') AS input_ids FROM encoded""")
def encode_tokens(spark, sf_dir):
    framed = F.concat(F.array(F.lit(labels.START_ID)), F.col("ids"), F.array(F.lit(labels.END_ID)))
    return _encoded(spark, sf_dir).select("doc_id", _spaced(framed).alias("input_ids"))


PAD = f"list_transform(range({MAX_LENGTH}), lambda i: 1)"
FIXED = f"([0] || ids[1:{MAX_LENGTH - 2}] || [2] || {PAD})[1:{MAX_LENGTH}]"


@query("encode_fixed_len", sql=f"WITH {VOCAB} SELECT doc_id, array_to_string({FIXED}, ' ') AS input_ids FROM encoded")
def encode_fixed_len(spark, sf_dir):
    return _encoded(spark, sf_dir).select(
        "doc_id", _spaced(labels.fixed_length_ids(F.col("ids"), MAX_LENGTH)).alias("input_ids"))


@query("encode_hard_cut", sql=f"""
WITH {VOCAB} SELECT doc_id, array_to_string(([0] || ids || [2] || {PAD})[1:{MAX_LENGTH}], ' ') AS input_ids FROM encoded""")
def encode_hard_cut(spark, sf_dir):
    return _encoded(spark, sf_dir).select(
        "doc_id", _spaced(labels.hard_cut_ids(F.col("ids"), MAX_LENGTH)).alias("input_ids"))


@query("attention_mask", sql=f"""
WITH {VOCAB} SELECT doc_id, array_to_string(list_transform({FIXED}, lambda x: CASE WHEN x = 1 THEN 0 ELSE 1 END), ' ') AS mask,
       least(len(ids) + 2, {MAX_LENGTH})::int AS n_visible FROM encoded""")
def attention_mask(spark, sf_dir):
    mask = labels.attention_mask(labels.fixed_length_ids(F.col("ids"), MAX_LENGTH))
    return _encoded(spark, sf_dir).select("doc_id", mask.alias("m")).select(
        "doc_id", _spaced(F.col("m")).alias("mask"), F.aggregate("m", F.lit(0), lambda a, x: a + x).alias("n_visible"))


def _lengths(spark, sf_dir):
    docs = kept_docs(spark, sf_dir).filter(corpus.split_of(F.col("doc_id")) != "validation")
    return docs.select((F.size("words") + 2).alias("n_tokens"))


LENGTHS = f"lengths AS (SELECT len(words) + 2 AS n_tokens FROM kept WHERE {s.split_of('doc_id')} <> 'validation')"


@query("token_length_hist", sql=f"""
WITH {KEPT}, {LENGTHS} SELECT (n_tokens // 50) * 50 AS from_tokens, count(*) AS n_texts FROM lengths GROUP BY 1""")
def token_length_hist(spark, sf_dir):
    return explore.length_histogram(_lengths(spark, sf_dir), "n_tokens", 50)


@query("token_length_stats", sql=f"""
WITH {KEPT}, {LENGTHS}
SELECT count(*) AS n_texts, max(n_tokens)::bigint AS max_tokens, round(avg(n_tokens), 6) AS mean_tokens,
       quantile_cont(n_tokens::double, 0.5) AS median_tokens, round(quantile_cont(n_tokens::double, 0.95), 6) AS p95_tokens,
       round(avg((n_tokens > 256)::int), 6) AS share_over_256, round(avg((n_tokens > 512)::int), 6) AS share_over_512
FROM lengths""")
def token_length_stats(spark, sf_dir):
    return explore.length_stats(_lengths(spark, sf_dir), "n_tokens", (256, 512))


@query("category_distribution", sql=f"""
SELECT {s.split_of('doc_id')} AS split, lang AS category, count(*) AS n_rows FROM documents GROUP BY ALL""")
def category_distribution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        corpus.split_of(F.col("doc_id")).alias("split"), F.col("lang").alias("category"))
    return explore.category_distribution(docs, "split", "category")


@query("distinct_categories", sql="""
SELECT source AS category, min(doc_id) AS first_seen FROM documents GROUP BY 1""")
def distinct_categories(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("category"), "doc_id")
    return explore.distinct_categories(docs, "category", "doc_id")


@query("preview", sql="SELECT doc_id, text, lang FROM documents ORDER BY doc_id LIMIT 20")
def preview(spark, sf_dir):
    return explore.preview(_docs(spark, sf_dir, "lang"), "doc_id", 20)


@query("sample_rows", sql="SELECT doc_id, text, lang FROM documents ORDER BY md5(doc_id::varchar), doc_id LIMIT 5")
def sample_rows(spark, sf_dir):
    return explore.sample_rows(_docs(spark, sf_dir, "lang"), "doc_id", 5)


@query("table_info", sql="""
SELECT 'doc_id' AS column_name, count(doc_id) AS non_null, 'bigint' AS dtype FROM documents
UNION ALL SELECT 'text', count(text), 'string' FROM documents
UNION ALL SELECT 'lang', count(lang), 'string' FROM documents
UNION ALL SELECT 'source', count(source), 'string' FROM documents
UNION ALL SELECT 'n_chars', count(n_chars), 'bigint' FROM documents""")
def table_info(spark, sf_dir):
    return explore.table_info(table(spark, sf_dir, "documents"))


@query("words_per_language", sql=f"""
WITH {KEPT} SELECT lang, count(*) AS n_docs, sum(len(words))::bigint AS n_words FROM kept GROUP BY 1""")
def words_per_language(spark, sf_dir):
    docs = kept_docs(spark, sf_dir, "lang")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("words")).alias("n_words"))
