"""The learned sentence model against plain versions, and what it is for."""

import math
import random
from collections import Counter

import pytest

from presswork.operators import sentences

rng = random.Random(9)
WORDS = ["river", "stone", "bridge", "market", "paper", "winter", "harbour", "candle"]
NAMES = ["Kora", "Milo", "Tessa"]


def made_text():
    out = []
    for _ in range(rng.randint(1, 6)):
        middle = [rng.choice([*WORDS, "Dr. " + rng.choice(NAMES), "approx. 5"]) for _ in range(rng.randint(2, 5))]
        out.append(" ".join([rng.choice(["The", "But"]), *middle, rng.choice(WORDS)]) + ".")
    return " ".join(out).replace(". The", rng.choice([". The", ".\nThe"]), 1)


TEXTS = [made_text() for _ in range(120)] + [None, "", " . .. ...", "No end", "the river but the stone"]


@pytest.fixture(scope="module")
def lines(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    return frame.select("id", sentences.line_tokens(frame.text).alias("lines"))


@pytest.fixture(scope="module")
def model(lines):
    return sentences.learn(lines, "lines")


def plain_model(texts):
    words, after = Counter(), Counter()
    bare = lambda t: t.rstrip(".").lower()
    tokens = [line.split() for text in texts if text for line in text.split("\n")]
    for line in tokens:
        words.update((bare(t), t.endswith(".")) for t in line)
    n, dots = sum(words.values()), sum(k for (_, dotted), k in words.items() if dotted)
    log = lambda k, x: k * math.log(x) if k else 0.0
    short = {}
    for w in {w for w, _ in words if any(c.isalpha() for c in w)}:
        a, b, size = words[w, True], words[w, False], len(w.replace(".", ""))
        score = -2 * (log(a, dots / n) + log(b, 1 - dots / n) - log(a, 0.99) - log(b, 1 - 0.99))
        score *= math.exp(-size) * (w.count(".") + 1) * size ** -b
        if a and score >= 0.3:
            short[w] = score
    for line in tokens:
        for t, follower in zip(line, line[1:]):
            if t.endswith(".") and bare(t) not in short and any(c.isalpha() for c in bare(t)) and any(c.isalpha() for c in follower):
                after[bare(follower)] += 1
    ends, first = sum(after.values()), {}
    for w, k in after.items():
        own = words[w, True] + words[w, False]
        part = lambda k, n, x: log(k, x) + log(n - k, 1 - x)
        score = 2 * (part(k, ends, k / ends) + part(own - k, n - ends, (own - k) / (n - ends))
                     - part(k, ends, own / n) - part(own - k, n - ends, own / n))
        if score >= 30 and k / ends > own / n:
            first[w] = score
    return short, first


def test_scores(model):
    for stored, plain in zip(model, plain_model(TEXTS)):
        assert {r.type: pytest.approx(r.score, rel=1e-9) for r in stored.collect()} == plain and plain
    assert {"dr"} <= {r.type for r in model[0].collect()} and {r.type for r in model[1].collect()} == {"the", "but"}


@pytest.mark.parametrize("fits", [True, False])
def test_no_end_after_an_abbreviation(lines, model, fits):
    rows = {r.id: r for r in sentences.split_learned(lines, "id", "lines", *model, fits=fits).collect()}
    assert len(rows) == len(TEXTS) and rows[120].sentences is None and rows[121].sentences == []
    assert rows[122].sentences == [".", "..", "..."] and rows[123].sentences == ["No end"]
    for i, text in enumerate(TEXTS[:120]):
        assert " ".join(rows[i].sentences) == " ".join(text.split())
        # each sentence was made with "The" or "But" at its beginning and nowhere else
        assert all(s.split()[0] in ("The", "But") and s.endswith(".") for s in rows[i].sentences)
        assert len(rows[i].sentences) == sum(t in ("The", "But") for t in text.split())


def test_nothing_to_learn(lines):
    short, first = sentences.learn(lines.limit(0), "lines")
    assert short.isEmpty() and first.isEmpty()
    plain = sentences.split_learned(lines, "id", "lines", short, first).filter("id = 123").first()
    assert plain.sentences == ["No end"]
