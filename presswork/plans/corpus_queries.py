"""Corpus assembly, splits and dataset shaping over documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import text as txt
from presswork.functions.labels import label_decode, label_encode, one_hot, first_max
from presswork.operators import corpus, shaping
from presswork.plans import sql_text as s
from presswork.plans.registry import query, table, text_table

LANGS = ("de", "en", "es", "fr")
# one language is left out on purpose: its rows are "unknown"
KNOWN_LANGS = ("de", "en", "es")


@query("assemble_content", sql="""
SELECT doc_id, concat_ws(' ', string_split(text, chr(10))[1], string_split(text, chr(10))[2], text,
       array_to_string([lang, source], ' ')) AS content FROM documents""")
def assemble_content(spark, sf_dir):
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        corpus.content(F.get(lines, F.lit(0)), F.get(lines, F.lit(1)), F.col("text"), F.array("lang", "source"))
        .alias("content"),
    )


CLEAN_HTML_SQL = r"""
WITH bare AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t
  FROM pages),
decoded AS (
  SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t,
    '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&') AS t
  FROM bare)
SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS body FROM decoded"""


@query("clean_html", sql=CLEAN_HTML_SQL)
def clean_html(spark, sf_dir):
    return text_table(spark, sf_dir, "pages", "page_id").select("page_id", txt.clean_html(F.col("html")).alias("body"))


@query("scrub_links_emails_numbers", sql=r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(?:https?://|www\.)\S+', ' ', 'g'),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', ' ', 'g'),
  '[0-9]+(?:[.,][0-9]+)*', ' ', 'g'), '\s+', ' ', 'g')) AS scrubbed FROM documents""")
def scrub(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", txt.scrub_links_emails_numbers(F.col("text")).alias("scrubbed"))


@query("fold_category", sql="""
SELECT doc_id, replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D') AS category FROM documents""")
def fold_category(spark, sf_dir):
    # whole texts stand for category names, so that every accented letter is met
    return table(spark, sf_dir, "documents").select("doc_id", corpus.category_of(F.array("text", "lang")).alias("category"))


@query("balanced_subset", sql="""
SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::varchar), doc_id) <= 100""")
def balanced_subset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return corpus.balanced_subset(docs, "lang", "doc_id", 100, LANGS)


@query("split_70_15_15", sql=f"SELECT doc_id, {s.split_of('doc_id')} AS split FROM documents")
def split_70_15_15(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", corpus.split_of(F.col("doc_id")).alias("split"))


@query("split_summary_rollup", sql=f"""
SELECT CASE WHEN grouping(split) = 1 THEN 'total' ELSE split END AS dataset, count(*) AS n_rows
FROM (SELECT {s.split_of('doc_id')} AS split FROM documents) GROUP BY ROLLUP (split)""")
def split_summary_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(corpus.split_of(F.col("doc_id")).alias("split"))
    return corpus.split_summary(docs)


def _train_and_validation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", corpus.split_of(F.col("doc_id")).alias("split"))
    parts = [docs.filter(F.col("split") == name) for name in ("train", "validation")]
    return shaping.union_parts(parts, "doc_id")


TRAIN_VALID = f"""
split_docs AS (SELECT doc_id, lang, {s.split_of('doc_id')} AS split FROM documents),
train_valid AS (
  SELECT *, row_number() OVER (ORDER BY split, doc_id) - 1 AS row_ix FROM split_docs WHERE split <> 'test')
"""


@query("union_train_valid", sql=f"WITH {TRAIN_VALID} SELECT doc_id, lang, split, row_ix FROM train_valid")
def union_train_valid(spark, sf_dir):
    return _train_and_validation(spark, sf_dir)


@query("stratified_kfold", sql=f"""
WITH {TRAIN_VALID}, {s.kfold('train_valid', 'lang', 'row_ix')}
SELECT doc_id, lang, row_ix, kfold FROM folded""")
def stratified_kfold(spark, sf_dir):
    return shaping.stratified_kfold(_train_and_validation(spark, sf_dir).drop("split"), "lang", "row_ix")


@query("fold_train_valid_counts", sql=f"""
WITH src AS (SELECT doc_id, source FROM documents), {s.kfold('src', 'source', 'doc_id')},
sizes AS (SELECT source, kfold, count(*) AS n_valid FROM folded GROUP BY ALL)
SELECT kfold, source, (sum(n_valid) OVER (PARTITION BY source) - n_valid)::bigint AS n_train, n_valid FROM sizes""")
def fold_train_valid_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return shaping.fold_counts(shaping.stratified_kfold(docs, "source", "doc_id"), "source")


@query("assign_batches", sql="""
SELECT doc_id, row_number() OVER (ORDER BY md5('411:' || doc_id), doc_id) - 1 AS position,
       (row_number() OVER (ORDER BY md5('411:' || doc_id), doc_id) - 1) // 16 AS batch FROM documents""")
def assign_batches(spark, sf_dir):
    return shaping.assign_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 16, seed=411)


@query("label_encode", sql="""
SELECT doc_id, lang, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE -1 END AS code FROM documents""")
def encode_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", label_encode(F.col("lang"), KNOWN_LANGS).alias("code"))


@query("label_decode", sql="""
SELECT doc_id, lang AS original, CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS decoded FROM documents""")
def decode_labels(spark, sf_dir):
    code = label_encode(F.col("lang"), KNOWN_LANGS)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("original"), label_decode(code, KNOWN_LANGS).alias("decoded"))


@query("one_hot", sql="""
SELECT doc_id, (lang = 'de')::int AS is_de, (lang = 'en')::int AS is_en, (lang = 'es')::int AS is_es,
       (lang = 'fr')::int AS is_fr,
       CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS inverse FROM documents""")
def one_hot_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", one_hot(F.col("lang"), LANGS).alias("y"))
    names = sorted(LANGS)
    return rows.select(
        "doc_id", *[F.get("y", F.lit(i)).alias(f"is_{c}") for i, c in enumerate(names)],
        first_max(F.col("y")).alias("inverse"))
