"""Ranked search against scoring every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presswork.llm import ranked_search
from presswork.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=20):
    counted = [(k, Counter(terms(t))) for k, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for name, text in items:
        scored = []
        for key, c in counted:
            n = sum(c.values())
            score = 0
            for w in terms(text):
                if c[w]:
                    m = 100 - 25 + (25 * n * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m))
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(name, rank, None if null else key, -s) for rank, (s, null, key) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def test_query(spark):
    def read(name, key):
        return [(r[key], r.text) for r in spark.read.parquet(f"{SF_DIR}/{name}.parquet").select(key, "text").collect()]

    got = sorted((tuple(r) for r in QUERIES["op12_ranked_search"](spark, SF_DIR).collect()), key=str)
    assert got == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


DOCS = [(i, t) for i, t in enumerate(["a b c", "a a b", "A, b! c", "d", "", None, "...", "é É ẞ", "a b c", "x" * 5 + " a " * 50_000] * 3)]
DOCS += [(None, "a b c"), (None, "a b c"), (3, "d"), (3, "d")]
ITEMS = [(1, "a b c a"), (2, "a b c d d d"), (None, "d É"), (1, "a b c a"), (4, None), (5, " . "), (6, "unknown"), (7, "b c d a x xx xxxxx")]


@pytest.mark.parametrize("block_bytes", [1, 20, 1 << 16])
def test_edges(spark, block_bytes):
    docs = spark.createDataFrame([(k, t, "x", "y", 1) for k, t in DOCS], "doc_id long, text string, terms string, _item string, rank int")
    items = spark.createDataFrame([(*r, "z") for r in ITEMS], "item_id int, text string, score string")
    found = ranked_search.search(docs, items, top=5, block_bytes=block_bytes)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(DOCS, ITEMS, 5)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.search(docs.limit(0), items).isEmpty() and ranked_search.search(docs, items.limit(0)).isEmpty()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=14), max_size=8))
def test_shared_sets_add_up(items):
    sharing = ranked_search.share_terms(items, 10)
    made = {i: Counter([i]) for i in range(10)}
    for at, parts in enumerate(sharing.nodes, 10):
        assert all(p < at for p in parts)  # a graph without cycles, parts first
        made[at] = sum((made[p] for p in parts), Counter())
    assert [sum((made[p] for p in parts), Counter()) for parts in sharing.items] == [Counter(i) for i in items]
    # no two sets are left that two items share
    pairs = Counter((x, y) for parts in sharing.items for x in set(parts) for y in set(parts) if x < y and x >= 10)
    assert max(pairs.values(), default=0) <= 1


def test_sharing_saves_sums():
    items = [list(range(40)) + [50 + n] for n in range(30)] + [list(range(20)) + [90 + n] for n in range(30)]
    sharing = ranked_search.share_terms(items, 130)
    sums = sum(len(p) - 1 for p in [*sharing.nodes, *sharing.items])
    assert sums < 0.12 * sum(len(i) - 1 for i in items)


def test_best_keeps_ties_by_key():
    best = ranked_search.Best(1, 3)
    for start in range(0, 100, 10):
        best.offer(0, np.array([5] * 10), list(range(99 - start, 89 - start, -1)))
    assert [k for _, _, k in best.kept[0]] == [0, 1, 2]
