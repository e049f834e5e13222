"""Token spans against trying every window, and exclusions by form only."""

import base64
import hashlib
import random
import re

import pytest

from presswork.llm import secret_scan

SCANNER = secret_scan.Scanner()
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def word(n, rng, alphabet=ALPHABET):
    return "".join(rng.choice(alphabet) for _ in range(n))


def found(text):
    return [text[b:e] for b, k, e in SCANNER.spans(text)[1] if k == 3]


@pytest.mark.parametrize("before", ["commit ", "base64: ", "the digest ", "doi ", "uuid=", "see isbn ", "etag ", "sha256: ", "committed ", "recommit "])
def test_names_hide_no_secret_of_another_form(before):
    rng = random.Random(1)
    secrets = [word(37, rng) for _ in range(60)]
    assert sum(any(s in f for f in found(f"x {before}{s} end")) for s in secrets) == 60


def test_parts_joined_by_dots_are_found():
    rng = random.Random(2)
    for _ in range(60):
        joined = ".".join(word(15, rng) for _ in range(3))
        assert any(joined in f for f in found(f"got {joined} here"))


@pytest.mark.parametrize("name, kind", [("sha256", "sha256"), ("SHA-512", "sha512"), ("md5", "md5"), ("sha1", "sha1"), ("checksum", "sha384")])
def test_known_digests_are_left_out(name, kind):
    rng = random.Random(3)
    for _ in range(30):
        d = hashlib.new(kind, word(9, rng).encode())
        for form in (d.hexdigest().upper(), base64.b64encode(d.digest()).decode(), base64.urlsafe_b64encode(d.digest()).decode().rstrip("=")):
            for text in (f"{name}: {form}", f"{name}-{form}", f"({name} {form}).", f"{name}={form} x"):
                if not re.search("assign", secret_scan.joined(SCANNER.spans(text)[1])):
                    assert not found(text), text


@pytest.mark.parametrize("text", [
    "id 123e4567-e89b-12d3-a456-426614174000", "10.1000/xyz123-abc-qwx9-zz81-kq7", "on 2024-11-05-10-20-30-40-50-60", "at 192.168.100.200.10.20.30",
    "www.example.com/a-longer-path/index.html", "...................................", "version 1.0.0.1.2.3.4.5.6.7.8", "internationalization.internationalization"])
def test_identifiers_and_plain_runs_are_left_out(text):
    assert not found(text)


def windows(text):
    """Characters of all windows of whole tokens that are random by the ratio, from trying every window of every run."""
    covered = set()
    for m in re.finditer(r"[A-Za-z0-9+/_=.-]{%d,}" % secret_scan.MIN_RUN, text):
        ends = [m.start()]
        for token in SCANNER.encoding.encode_ordinary(m[0]):
            ends.append(ends[-1] + len(SCANNER.encoding.decode_single_token_bytes(token)))
        for i, a in enumerate(ends):
            # the shortest window that is long enough
            j = next((j for j in range(i, len(ends)) if ends[j] - a >= secret_scan.MIN_RUN), None)
            if j and (ends[j] - a) / (j - i) < secret_scan.MAX_RATIO and re.search("[A-Za-z]", text[a:ends[j]]):
                covered |= set(range(a, ends[j]))
    return covered


def test_spans_against_every_window():
    rng = random.Random(4)
    plain = ["download", "customer", "reports", "archive", "settings", "window"]
    hits = 0
    for _ in range(300):
        parts = [rng.choice([rng.choice(plain), word(rng.randint(4, 30), rng)]) for _ in range(rng.randint(1, 5))]
        text = "see " + rng.choice("/-_.").join(parts) + " end"
        base, every = SCANNER.spans(text)
        inside = {i for b, k, e in every if k == 3 for i in range(b, e)}
        random_part = windows(text)
        hits += bool(random_part)
        if not base:
            assert random_part <= inside and bool(random_part) == bool(inside)
        for b, k, e in every:
            if k == 3:  # a span begins and ends at a random window or goes on to the next "/" or "="
                assert random_part & set(range(b, e))
    assert hits > 100
