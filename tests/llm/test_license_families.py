"""Look-alike licences, several wordings and several windows of one text."""

import pytest

from presswork.llm import licenses

SCANNER = licenses.Scanner(licenses.TEMPLATES)


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_each_template_is_only_itself(name):
    assert {f[0] for f in SCANNER.scan(f"Before. {licenses.TEMPLATES[name]} After it.")} == {name.partition("#")[0]}


@pytest.mark.parametrize("text, name", [
    ("Licensed under the MIT License", "mit-notice"), ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0-notice"),
    ("Licensed under CC BY 4.0", "cc-by-4.0-notice"), ("Released under the Apache License 2.0", "apache-2.0-notice")])
def test_short_notices(text, name):
    assert {f[0] for f in SCANNER.scan(f"Text. {text}. More text")} == {name}


def test_every_window_is_reported():
    text = "Released under the MIT License. Some words. Released under the MIT License."
    assert [(n, text[b:e]) for n, _, b, e in SCANNER.scan(text)] == [("mit-notice", "Released under the MIT License")] * 2
