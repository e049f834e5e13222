"""The licence scanner against every window of every template, on texts with several overlapping ones."""

import random

import pytest

from presswork.llm import licenses
from tests.llm.test_contracts import license_scan

SCANNER = licenses.Scanner(licenses.TEMPLATES)


def test_against_every_window():
    rng = random.Random(1)
    bodies = list(licenses.TEMPLATES.values())
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 3)):
            own = rng.choice(bodies).split()
            for _ in range(rng.randint(0, 3)):  # edits
                own[rng.randrange(len(own))] = rng.choice(["word", "the", "license", "4.0"])
            words += own[rng.randint(0, 2):] + ["and"] * rng.randint(0, 4)
        text = " ".join(words)
        assert SCANNER.scan(text) == license_scan(text)


@pytest.mark.parametrize("text, name", [
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.", "gpl-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999", "lgpl-2.1"), ("Apache License\nVersion 2.0, January 2004", "apache-2.0"),
    ("This is distributed under the terms of the BSD license.", "bsd"), ("// SPDX-License-Identifier: MIT", "mit"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later\n", "gpl-2.0"), ("/* SPDX-License-Identifier: Apache-2.0 */", "apache-2.0"),
    ("Mozilla Public License Version 2.0\n====\n1. Definitions", "mpl-2.0"),
    ("Creative Commons Attribution-ShareAlike 4.0 International Public License\n\nBy exercising the Licensed Rights (defined below), You accept and agree "
     "to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License", "cc-by-sa-4.0"),
])
def test_bodies_and_tags(text, name):
    assert [n for n, *_ in SCANNER.scan("int main() " + text + " more words follow here")] == [name]


def test_any_number_of_templates():
    templates = {f"t{n}": f"alpha{n} beta{n} gamma{n} delta" for n in range(300)}
    scanner = licenses.Scanner(templates)
    assert [n for n, *_ in scanner.scan(" x ".join(templates[f"t{n}"] for n in (0, 63, 64, 299)))] == ["t0", "t63", "t64", "t299"]
