"""The rounds of the bootstrap against a plain version, and patterns that only a later round can trust."""

import math
from collections import defaultdict

import numpy as np
import pytest

from presswork.llm import pii


def brute(edges, rounds, min_seeds, min_score):
    instances = defaultdict(set)
    for pattern, instance, _ in edges:
        instances[pattern].add(instance)
    seeds = {i for _, i, seed in edges if seed}
    trusted = {}
    for _ in range(rounds):
        def belief(instance, judged):
            if instance in seeds:
                return 1.0
            if instance.isdigit() and len(instance) >= 14:  # a card number with a wrong check digit
                return 0.0
            others = [min(s, 0.999) for p, s in trusted.items() if p != judged and instance in instances[p]]
            return 1 - math.prod(1 - s for s in others)

        totals = {p: sum(belief(i, p) for i in own) for p, own in instances.items()}
        trusted = {p: t / len(instances[p]) for p, t in totals.items() if t >= min_seeds - 1e-9 and t / len(instances[p]) >= min_score - 1e-9}
    return trusted


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_scores(spark, rounds):
    random = np.random.default_rng(rounds)
    seeded = {i: bool(random.random() < 0.3) for i in range(60)}
    pairs = {(f"p{random.integers(25)}", int(random.integers(60))) for _ in range(220)}
    edges = [(p, f"i{i}" if i % 7 else "4" * 13 + str(1000 + i), seeded[i]) for p, i in pairs]
    got = pii.score_patterns(spark.createDataFrame(edges, "pattern string, instance string, seed boolean"), rounds, 2, 0.4).collect()
    want = brute(edges, rounds, 2, 0.4)
    assert {r.pattern for r in got} == set(want) and len(want) > 2
    assert all(abs(r.score - want[r.pattern]) < 1e-6 for r in got)


def test_a_second_round_trusts_a_pattern_without_seeds(spark):
    docs = [(i, f"we saw that mailbox user{i}@mail.example.com was there") for i in range(20)]
    # a first round trusts "mailbox" and with it these, which stand behind "badge" as well
    docs += [(30 + i, f"their mailbox QX-{i}7781-B is new") for i in range(5)]
    docs += [(40 + i, f"with badge QX-{i}7781-B he came") for i in range(5)]
    docs += [(50, "with badge ZZ-90210-K she came"), (51, "room number 17 is free"), (52, "room 18 was not")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {rounds: {s.body for r in pii.find_pii(frame, rounds=rounds).collect() for s in r.found} for rounds in (1, 4)}
    own = {f"QX-{i}7781-B" for i in range(5)}
    assert "ZZ-90210-K" not in found[1] and own | {"ZZ-90210-K"} <= found[4]
    assert not found[4] & {"17", "18"}


def test_patterns_on_either_side(spark):
    text = "Send it to: a@b.org please, or (b@c.org)"
    base = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().base
    assert [s.patterns for s in base] == [["1 to:", "2 it to:", "r please, or"], ["1 or", "2 please, or"]]


def test_numbers_that_fail_a_check_are_not_found(spark):
    docs = [(i, f"the card 453201511283036{d} was there") for i, d in enumerate("6" * 3)]
    docs += [(10 + i, f"the card user{i}@mail.example.org was there") for i in range(6)]
    docs += [(20, "the card 4532015112830361 was there"), (21, "the card 999.1.1.1 was there"), (22, "the card AB-1234-Z was there")]
    rows = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {s.body for r in rows for s in r.found} == {"AB-1234-Z"}
