"""Benchmark decontamination over several blocks of items."""

import numpy as np

from presswork.llm import decontaminate


def brute(text, items, window):
    words = decontaminate.normal_bytes(text).split()
    hit, names = set(), set()
    for name, body in items:
        own = decontaminate.normal_bytes(body).split()
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == own[i:i + size]:
                    hit |= set(range(j, j + size))
                    names.add(name)
    return hit, sorted(str(n) for n in names if n is not None)


def test_blocks_against_brute_force(spark):
    random = np.random.default_rng(2)
    vocabulary = [f"w{n}" for n in range(12)] + ["É", "x1"]
    items = [(n if n % 5 else None, " ".join(random.choice(vocabulary, random.integers(0, 9)))) for n in range(40)]
    docs = [(n, "-".join(random.choice(vocabulary, random.integers(0, 60)))) for n in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1, 100, 1 << 20):
        rows = decontaminate.add_hits(frame, benchmark, window=3, block_bytes=block_bytes, drop_text=True).collect()
        assert len(rows) == len(docs) and "text" not in rows[0]
        for r in rows:
            hit, names = brute(docs[r.doc_id][1], items, 3)
            assert {p for h in r.hit_ranges for p in range(h["first"], h["past"])} == hit and r["items"] == names


def test_blocks_come_one_at_a_time_and_are_bounded(spark):
    benchmark = spark.createDataFrame([(n, "é" * 10) for n in range(10)] + [(99, "x" * 500)], "item_id long, text string")
    sizes = [sum(len(t.encode()) for _, t in block) for block in decontaminate.blocks(benchmark, block_bytes=50)]
    assert sizes == [40] * 5 + [500]
    assert list(decontaminate.blocks(benchmark.limit(0))) == [[]]


def test_an_automaton_is_built_once_and_replaced():
    first = decontaminate.built_automaton("a", [("1", "one two")], 10)
    assert decontaminate.built_automaton("a", [("1", "other")], 10) is first
    decontaminate.built_automaton("b", [("1", "other")], 10)
    assert list(decontaminate._built) == ["b"]
