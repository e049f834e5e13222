"""Lexicon rounds and segmentations against plain versions."""

import itertools
import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presswork.functions.text import sentence_words
from presswork.operators import segment

TEXTS = ["hà nội là thủ đô. thủ đô hà nội rất đẹp", "thành phố hồ chí minh. hồ chí minh là người", "thủ đô là hà nội 12", None, "",
         "người hà nội. người thành phố", "thành phố hồ chí minh đẹp"] * 3 + ["một hai ba bốn năm"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    return frame.select("id", sentence_words(frame.text).alias("sentences"))


def brute_lexicon(texts, max_length=4, min_count=5, rounds=3):
    counts = Counter()
    for sentences in texts:
        for tokens in sentences or []:
            for i, k in itertools.product(range(len(tokens)), range(1, max_length + 1)):
                run = tuple(tokens[i:i + k])
                if len(run) == k and (k == 1 or all(any(c.isalpha() for c in t) for t in run)):
                    counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) == 1 or n >= min_count}
    expected = dict(counts)
    for _ in range(rounds):
        total = float(sum(expected.values()))
        chance = {}
        for w in counts:
            own, rival = expected[w] * total, 0.0
            for i in range(1, len(w)):
                rival += float(expected[w[:i]]) * expected[w[i:]]
            chance[w] = 1.0 if len(w) == 1 else own / (own + rival) if own + rival > 0 else 0.0
        head, rest = Counter(), Counter()
        for w in counts:
            if len(w) > 1:
                head[w[:-1]] += math.floor(counts[w] * chance[w])
                rest[w[1:]] += math.floor(counts[w] * chance[w])
        expected = {w: math.floor((counts[w] - max(head[w], rest[w])) * chance[w]) for w in counts}
    expected = {w: max(e, 1) if len(w) == 1 else e for w, e in expected.items()}
    expected = {w: e for w, e in expected.items() if e > 0}
    total = sum(expected.values())
    return {" ".join(w): (counts[w], e, round(1000 * math.log(total / e))) for w, e in expected.items()}


def test_lexicon(docs):
    want = brute_lexicon([r.sentences for r in docs.collect()])
    got = {r.word: (r.n, r.expected, r.cost) for r in segment.learn_lexicon(docs, "sentences").collect()}
    assert got == want and "hồ chí minh" in got and "hà nội" in got
    assert segment.learn_lexicon(docs.limit(0), "sentences").isEmpty()


@pytest.mark.parametrize("fits", [True, False])
def test_segmentation(docs, fits):
    lexicon = segment.learn_lexicon(docs, "sentences")
    rows = {r.id: r for r in segment.segment(docs, "id", "sentences", lexicon, fits=fits).collect()}
    assert len(rows) == len(TEXTS) and rows[3].segmented is None and rows[4].segmented.words == []
    assert "hà_nội" in rows[5].segmented.words[0] and "hồ_chí_minh" in rows[1].segmented.words[1]
    cost = {r.word: r.cost for r in lexicon.collect()}
    for r in rows.values():
        if r.segmented:
            assert ["_".join(s) for s in r.sentences] == ["_".join(s) for s in r.segmented.words]
            assert r.segmented.cost == sum(cost[w.replace("_", " ")] for s in r.segmented.words for w in s)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.dictionaries(st.text("abc", min_size=1, max_size=4).map(" ".join), st.integers(0, 30)))
def test_best_path_against_all_paths(tokens, cost):
    words, least = segment.best_path(tokens, cost, 12, 4)
    paths = []
    for cuts in itertools.product([0, 1], repeat=max(len(tokens) - 1, 0)):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(tokens)]
        parts = [" ".join(tokens[a:b]) for a, b in zip(edges, edges[1:])] if tokens else []
        if all(p in cost or " " not in p for p in parts) and all(len(p.split()) <= 4 for p in parts):
            paths.append(sum(cost.get(p, 12) for p in parts))
    assert least == min(paths) and sum(cost.get(w.replace("_", " "), 12) for w in words) == least
