"""SQL fragments for the oracle side; every fragment is independent of the Spark expressions."""

from __future__ import annotations

SP = r"\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def stripped(text: str) -> str:
    return rf"regexp_replace({text}, '[^\p{{L}}\p{{N}}_.{SP}]', '', 'g')"


def sents(text: str) -> str:
    """List of trimmed non-empty sentences (RE2 has no look-behind: mark the break first)."""
    marked = rf"regexp_replace({text}, '([.!?])[{SP}]+', '\1' || chr(10), 'g')"
    parts = rf"string_split_regex({marked}, '\n+')"
    trimmed = rf"list_transform({parts}, lambda s: regexp_replace(s, '\A[{SP}]+|[{SP}]+\z', '', 'g'))"
    return f"list_filter({trimmed}, lambda s: s <> '')"


def toks(sentence: str) -> str:
    dotted = rf"regexp_replace({sentence}, '\.+[{SP}]*\z', ' .')"
    return f"list_filter(string_split_regex({dotted}, '[{SP}]+'), lambda t: t <> '')"


def sent_toks(text: str) -> str:
    return f"list_transform({sents(stripped(text))}, lambda q: {toks('q')})"


def kept(text: str) -> str:
    """List of lower-cased words: a token with no letter is a number or punctuation."""
    return (
        rf"list_transform(list_filter(flatten({sent_toks(text)}), lambda w: regexp_matches(w, '\p{{L}}')), "
        "lambda w: lower(w))"
    )


def processed(text: str) -> str:
    return f"array_to_string({kept(text)}, ' ')"


def hash8(value: str) -> str:
    return f"('0x' || substr(md5(({value})::varchar), 1, 8))::bigint"


def split_of(key: str) -> str:
    h = f"{hash8(key)} % 100"
    return f"CASE WHEN {h} < 70 THEN 'train' WHEN {h} < 85 THEN 'test' ELSE 'validation' END"


# one row per token of every document
TOKENS = f"""
sent_rows AS (
  SELECT doc_id, unnest(ss) AS ws, generate_subscripts(ss, 1) - 1 AS sent
  FROM (SELECT doc_id, {sent_toks('text')} AS ss FROM documents)),
tokens AS MATERIALIZED (
  SELECT doc_id, sent, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS pos FROM sent_rows)
"""


def kfold(source: str, label: str, order: str, k: int = 5) -> str:
    """CTEs ending in ``folded``: the rows of ``source`` with ``kfold``."""
    return f"""
kf_classes AS (
  SELECT {label}, count(*) AS n, min({order}) AS first_seen FROM {source} GROUP BY 1),
kf_offsets AS (
  SELECT *, coalesce(sum(n) OVER (ORDER BY first_seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS off
  FROM kf_classes),
kf_quota AS (
  SELECT {label}, fold, (floor((off + n - 1 - fold) / {k}.0) - floor((off - 1 - fold) / {k}.0))::bigint AS q
  FROM kf_offsets, (SELECT unnest(range({k}))::int AS fold)),
kf_ranges AS (
  SELECT {label}, fold, sum(q) OVER (PARTITION BY {label} ORDER BY fold) AS hi,
         sum(q) OVER (PARTITION BY {label} ORDER BY fold) - q AS lo
  FROM kf_quota),
kf_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {order}) - 1 AS r FROM {source}),
folded AS (
  SELECT s.*, g.fold AS kfold
  FROM kf_ranked s JOIN kf_ranges g ON s.{label} = g.{label} AND s.r >= g.lo AND s.r < g.hi)
"""
