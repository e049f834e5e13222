"""Tag counts and best tag sequences against plain versions."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presswork.operators import tagging

TAUGHT = [[("Cat", "N"), ("sees", "V"), ("Bo", "Np"), (".", "CH")], [("light", "N"), ("lights", "V"), ("light", "A"), ("cat", "N")],
          [("light", "A"), ("cat", "N"), ("sees", "V")], [("7", "M"), ("cats", "N")]]
SENTENCES = [[["light", "light", "sees", "Bo"], ["cats"]], [["Unknown", "words", "lights"], []], [], None, [["7", "x", "ss"]]]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, tag, s[i + 1][1] if i + 1 < len(s) else None, i == 0) for s in TAUGHT for i, (t, tag) in enumerate(s)]
    return tagging.learn_tagger(spark.createDataFrame(rows, "token string, tag string, next_tag string, first boolean"))


def plain_costs():
    """Cost of a tag after a tag (or after nothing), and of a word by tag."""
    pairs, uses, ends, totals = Counter(), Counter(), Counter(), Counter()
    for s in TAUGHT:
        pairs.update(zip(["", *[tag for _, tag in s]], [tag for _, tag in s]))
        for token, tag in s:
            uses[token.lower(), tag] += 1
            ends[token.lower()[-2:], tag] += 1
            totals[tag] += 1
    tags, endings = sorted(totals), {e for e, _ in ends}
    cost = lambda a, b: math.floor(-1000 * math.log(a / b) + 0.5)
    step = {(a, b): cost(pairs[a, b] + 1, sum(n for (x, _), n in pairs.items() if x == a) + len(tags)) for a in ["", *tags] for b in tags}

    def word(token, tag):
        token = token.lower()
        if any(w == token for w, _ in uses):
            return cost(uses[token, tag], totals[tag]) if uses[token, tag] else math.inf
        return cost(ends[token[-2:], tag] + 1, totals[tag] + len(endings))

    return tags, step, word


@pytest.mark.parametrize("fits", [True, False])
def test_sequences_against_all_sequences(spark, model, fits):
    tags, step, word = plain_costs()
    assert model.tags == tags
    frame = spark.createDataFrame(list(enumerate(SENTENCES)), "id long, sentences array<array<string>>")
    rows = {r.id: r.tagged for r in tagging.tag_sequences(frame, "id", "sentences", model, fits=fits).collect()}
    assert len(rows) == len(SENTENCES) and rows[3] is None and rows[2].tags == []
    for i, sentences in enumerate(SENTENCES):
        total = 0
        for tokens, chosen in zip(sentences or [], rows[i].tags if rows[i] else []):
            price = lambda way: sum(step[a, b] + word(t, b) for a, b, t in zip(["", *way], way, tokens))
            least = min(price(way) for way in itertools.product(tags, repeat=len(tokens)))
            assert len(chosen) == len(tokens) and price(chosen) == least
            total += least
        assert rows[i] is None or rows[i].cost == total
    assert rows[0].tags[0] == ["A", "N", "V", "Np"]  # one word with two tags, told apart by its place


def test_no_tags_to_learn(spark):
    none = tagging.learn_tagger(spark.createDataFrame([], "token string, tag string, next_tag string, first boolean"))
    frame = spark.createDataFrame([(1, [["a", "b"]])], "id long, sentences array<array<string>>")
    assert tagging.tag_sequences(frame, "id", "sentences", none).first().tagged.tags == [[None, None]]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_best_tags(data):
    k, n = data.draw(st.integers(1, 3)), data.draw(st.integers(1, 5))
    numbers = lambda *shape: np.array(data.draw(st.lists(
        st.integers(0, 9), min_size=math.prod(shape), max_size=math.prod(shape))), dtype=np.int64).reshape(shape)
    costs, first, steps = numbers(n, k), numbers(k), numbers(k, k)
    price = lambda way: first[way[0]] + sum(costs[i, t] for i, t in enumerate(way)) + sum(steps[a, b] for a, b in zip(way, way[1:]))
    path, least = tagging.best_tags(costs, first, steps)
    ways = [w for w in itertools.product(range(k), repeat=n)]
    assert least == min(map(price, ways)) == price(path)
    assert tuple(path[::-1]) == min(w[::-1] for w in ways if price(w) == least)
