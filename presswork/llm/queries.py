"""Registered queries: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import (
    alignment, decontaminate, embedding, fingerprint, licenses, packing, pii, quality, ranked_search, secret_scan, sharding, simhash, urls,
)
from presswork.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"),
                        "best_license", F.round("best_score", 6).alias("best_score"), F.array_join(spans, ",").alias("spans"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


HELD_OUT = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2"


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(f"not ({HELD_OUT})")
    # the statistics of all documents are stored, so texts are read once for fitting and scoring
    stored = materialise(quality.with_statistics(docs, drop_text=True), "statistics")
    model = quality.fit(quality.labelled(stored, labels))
    return quality.score_statistics(stored, model).select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op5_quartile_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edited(table(spark, sf_dir, "documents"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    marked = decontaminate.add_hits(docs.select("doc_id", "text"), benchmark, drop_text=True)
    return marked.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_ranges") > 0).alias("contaminated"))


@query
def op7_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_found", F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.joined(F.array_sort(F.concat("base", "found"))).alias("spans"))


@query
def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a deployment's own list, a table whose first column holds hosts or hosts with paths; else the short default
    path = spark.conf.get("spark.presswork.blocklist", None)
    return urls.judge_urls(table(spark, sf_dir, "pages"), entries=spark.read.parquet(path) if path else None)


@query
def op10_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


@query
def op11_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


_LISTED = ", ".join(f"'{h}'" for h in urls.BLOCKED_HOSTS)
ORACLES["op9_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '') AS raw_host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages
), p AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN '.' || host LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN '.' || host LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN '.' || host LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN '.' || host LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN '.' || host LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM p
), judged AS (
  SELECT *, len(list_filter([{_LISTED}], lambda h: ends_with('.' || host, '.' || h) OR h = host || path)) > 0 AS listed FROM ruled
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
    WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op6_benchmark_decontamination"] = f"""
WITH docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
items AS (
  SELECT item_id, words, least({decontaminate.WINDOW}, len(words)) AS size
  FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
item_windows AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM items)),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT size FROM items))),
hits AS MATERIALIZED (SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, w)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS id FROM hits) GROUP BY 1)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

# exact: at this scale the operator's index misses no pair, which its tests hold on planted ones
ORACLES["op11_embedding_near_duplicates"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {embedding.THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)
JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1) USING (vec_id)
"""

ORACLES["op12_ranked_search"] = f"""
WITH words AS (SELECT doc_id, unnest(coalesce({_WORDS}, [])) AS w FROM documents),
tf AS MATERIALIZED (SELECT doc_id, w, count(*)::bigint AS tf FROM words GROUP BY 1, 2),
lengths AS (SELECT doc_id, sum(tf)::bigint AS n FROM tf GROUP BY 1),
corpus AS (SELECT count(*)::bigint AS n_docs, sum(n)::bigint AS n_terms FROM lengths),
asked AS (SELECT item_id, w, count(*)::bigint AS times FROM (SELECT item_id, unnest(coalesce({_WORDS}, [])) AS w FROM benchmark) GROUP BY 1, 2),
weights AS (
  SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::bigint AS weight
  FROM (SELECT w, count(*)::bigint AS df FROM tf GROUP BY 1), corpus),
scored AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint AS score
  FROM asked JOIN weights USING (w) JOIN tf USING (w) JOIN lengths USING (doc_id), corpus GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {ranked_search.TOP}
"""
