"""Fingerprints and quality scores of whole queries against plain versions written from the modules' descriptions."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from presswork.llm import fingerprint, quality
from presswork.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


def plain_codes(data):
    counts, gap = [0] * 256, 4
    if len(data) > 2 * gap:
        hashes = [data[i] * 0x9E3779B1 + data[i + gap] * 0x85EBCA77 + data[i + 2 * gap] * 0xC2B2AE3D for i in range(len(data) - 2 * gap)]
    else:
        hashes = [b * 0x9E3779B1 + i * 0x85EBCA77 for i, b in enumerate(data)]
    for h in hashes:
        h %= 2 ** 32
        h ^= h >> 15
        counts[h * 0x2C1B3C6D % 2 ** 32 >> 24] += 1
    quartiles = [sorted(counts)[at] for at in (63, 127, 191)]
    return min(int(math.log(len(data) + 1) / math.log(1.25)), 255), [sum(q < c for q in quartiles) for c in counts]


def plain_digest(length, codes):
    return f"{length:02x}" + "".join(f"{int(''.join(f'{c:02b}' for c in codes[i:i + 4]), 2):02x}" for i in range(0, 256, 4))


def plain_likeness(one, other):
    apart = sum(abs(a - b) for a, b in zip(one[1], other[1])) + 4 * abs(one[0] - other[0])
    return 1 - min(apart, 320) / 320


@pytest.mark.parametrize("data", [b"", b"a", b"abcdefgh", b"abcdefghi", bytes(range(256)) * 3, b"\xff" * 5000])
def test_digest(data):
    assert fingerprint.digest(data) == plain_digest(*plain_codes(data))


def test_op5_against_a_plain_version(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op5_quartile_fingerprint"](spark, SF_DIR).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for doc_id, after in zip(ids, ids[1:] + ids[:1]):
        text, other, row = texts[doc_id], texts[after], rows[doc_id]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + other[:cut]
        own, changed, following = (plain_codes(t.encode()) for t in (text, edited, other))
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == (plain_digest(*own), plain_digest(*changed))
        assert row.near_edited == pytest.approx(plain_likeness(own, changed)) and row.near_next == pytest.approx(plain_likeness(own, following))


def plain_statistics(text):
    data, words, lines = text.encode(), text.split(), text.split("\n")
    size, n = max(len(data), 1), max(len(words), 1)

    def share(test):
        return math.sqrt(sum(map(test, data)) / size)

    spaces, stops = b" \t\n\v\f\r", b".,;:'\"()-"
    letter_or_digit = lambda b: chr(b).isalnum() and b < 128
    return [
        math.log1p(len(data)), math.log1p(len(words)), math.log1p(sum(map(len, words)) / n), math.sqrt(len(set(words)) / n),
        math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / n), share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57),
        share(lambda b: b in spaces), share(lambda b: b in stops),
        share(lambda b: b < 128 and not letter_or_digit(b) and b not in spaces and b not in stops), share(lambda b: b == 124),
        share(lambda b: b >= 128), math.log1p(len(lines)), math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt(sum(len(w) > 25 for w in words) / n), math.sqrt(sum(w.rstrip(".,;:!?").isalpha() for w in words) / n),
    ]


@pytest.mark.parametrize("text", ["", "\n\n", "Ab 12|#é — x x", "a" * 30 + " a.", "\x00\t\x7f\x0b"])
def test_statistics(text):
    assert quality.statistics(text) == pytest.approx(plain_statistics(text))


def test_op3_against_a_plain_version(spark, texts):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    x = {i: np.array(plain_statistics(t)) for i, t in texts.items()}
    groups = [np.array([x[i] for i, m in marks.items() if m == k and not held[i]]) for k in (0, 1)]
    total, d = sum(map(len, groups)), len(quality.STATISTICS)
    scatter = [(len(g) - 1) * np.cov(g.T) for g in groups]
    pooled = sum(scatter) / (total - 2)
    pooled += np.diag(np.diag(pooled) * 1e-6 + 1e-6)

    def log_density(k):
        n = len(groups[k])
        own = 0.7 * (n - 1) / (n - 1 + d)
        cov = own * scatter[k] / (n - 1) + (1 - own) * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov))
        inverse, log_det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        return {i: math.log(n / total) - log_det / 2 - (v - groups[k].mean(0)) @ inverse @ (v - groups[k].mean(0)) / 2 for i, v in x.items()}

    low, high = log_density(0), log_density(1)
    z = {i: math.asinh(high[i] - low[i]) for i in x}
    learnt = [i for i, m in marks.items() if m in (0, 1) and not held[i]]
    middle = np.array([(math.floor((z[i] + 32) * 32) + 0.5) / 32 - 32 for i in learnt])
    y = np.array([marks[i] for i in learnt])

    def cost(slope, shift):
        t = slope * middle + shift
        return np.sum(np.logaddexp(0, t) - y * t) + 0.05 * ((slope - 1) ** 2 + shift ** 2)

    # the lowest point by ever finer steps along both axes and diagonals
    at, step = (1.0, 0.0), 1.0
    while step > 1e-7:
        near = min(((at[0] + a * step, at[1] + b * step) for a in (-1, 0, 1) for b in (-1, 0, 1)), key=lambda w: cost(*w))
        at, step = (near, step) if cost(*near) < cost(*at) else (at, step / 2)
    rows = {r.doc_id: r for r in QUERIES["op3_quality_classifier"](spark, SF_DIR).collect()}
    assert sorted(rows) == sorted(texts)
    for i, row in rows.items():
        want = 1 / (1 + math.exp(-(max(at[0], 0.05) * z[i] + at[1])))
        assert row.held_out == held[i] and row.score == pytest.approx(want, abs=1e-4)
        assert row.predicted == int(row.score >= 0.7)
