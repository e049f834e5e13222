"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from presswork.llm import (
    decontaminate, fingerprint, licenses, packing, pii, quality, secret_scan, sharding, simhash, urls,
)
from tests.llm.test_contracts import brute_components, brute_fingerprint, jump, pii_base

LONG = "wörd one2 a.b " * 30_000
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (2, None), (3, ""), (4, "   \n\t "),
    (5, LONG), (6, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (7, "a@b.c +1 (487) 555-7209 1.2.3.4"),
    (7, "a@b.c +1 (487) 555-7209 1.2.3.4"), (None, "token = 'abcdefgh12345678' x"), (9, "\U0001F600 ẞ İ ǅ token=secret:abcdefghij"),
]
SCHEMA = ("doc_id long, text string, fp string, score string, n_words string, hit_ranges string, items string, redacted string, "
          "spans string, n_chars long, _text string, statistics string, component_id string, shard string, length string")


def frame(spark, rows):
    return spark.createDataFrame([(k, t, *["x"] * 7, 3 if t is None else len(t), *["y"] * 5) for k, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "gamma DELTA, epsilon zeta eta theta iota kappa lambda mu nu"), (2, None), (3, "..."), (None, "alpha"), (1, "gamma"), (12, "")],
        "item_id long, text string")


def keys(df, name="doc_id"):
    return sorted((r[name] is None, r[name] or 0) for r in df.select(name).collect())


ALL = sorted((k is None, k or 0) for k, _ in TEXTS)


def test_licenses(docs, none):
    assert keys(licenses.scan_licenses(docs)) == ALL and licenses.scan_licenses(none).isEmpty()


def test_license_spans_and_bounds():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    text = "Éa. RELEASED under the MIT  licence! Licensed under CC BY-NC 4.0. x"
    found = {n: text[b:e] for n, s, b, e in scanner.scan(text) if s == 1}
    assert found == {"mit-notice": "RELEASED under the MIT  licence", "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0"}
    assert scanner.scan("") == scanner.scan("license") == []
    repeated = scanner.scan(licenses.TEMPLATES["isc"] * 300)
    assert ("isc", 1.0) in [(n, s) for n, s, _, _ in repeated]


def test_packing(docs, none):
    rows = packing.pack_documents(docs, limit=1000, with_ids=True)
    got = rows.collect()
    assert set(keys(rows)) == set(ALL) and all(r.length <= 1000 for r in got)
    assert [r.length for r in got if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    for ids in [r.ids for r in packing.sequences(rows).collect()]:
        assert len(ids) <= 4000
    assert packing.pack_documents(none).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_uses_every_piece_once(histogram):
    patterns = packing.plan(histogram, 40)
    used: dict[int, int] = {}
    for parts, repeats in patterns:
        assert sum(n * t for n, t in parts) <= 40
        for n, t in parts:
            used[n] = used.get(n, 0) + t * repeats
    assert used == histogram
    runs = packing.plan_runs(patterns, histogram)
    places = set()
    total = sum(histogram.values())
    for number in range(total):
        first, sequence, offset, times, length = runs[np.searchsorted(runs[:, 0], number, "right") - 1]
        i = number - first
        start = offset + i % times * length
        places.update((sequence + i // times, p) for p in range(start, start + length))
    assert len(places) == sum(n * c for n, c in histogram.items())


@given(st.text(st.characters(codec="utf-8"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_is_the_tokenizer(text):
    enc = packing.encoder(packing.VOCABULARY)
    for t in (text, text.lower() + "'s, x1"):
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (4, 0), (None, 1), (6, None), (7, 3), (99, 1)], "doc_id long, quality int")
    stats = quality.with_statistics(docs.select("doc_id", "text"), drop_text=True)
    assert sorted(r.label for r in quality.labelled(stats, labels).collect()) == [0, 1]
    model = quality.fit(quality.labelled(stats, labels))
    assert keys(quality.add_scores(docs, model)) == ALL
    assert quality.accepted(docs, model).schema == docs.schema
    single = quality.fit(quality.labelled(stats, labels.where("quality = 1")))
    assert {r.score for r in quality.add_scores(docs, single).collect()} == {single.constant}
    empty = quality.fit(quality.labelled(stats, labels.limit(0)))
    assert empty.constant == 0.5 and quality.add_scores(none, empty).isEmpty()


def test_secrets(docs, none):
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    assert rows[None].spans == "assign:0:25" and rows[9].n_assign == 0 and rows[2].spans == ""
    assert secret_scan.scan_secrets(none).isEmpty()
    clean = secret_scan.redact_secrets(docs)
    assert clean.schema == docs.schema
    by_key = {r.doc_id: r for r in clean.collect()}
    assert by_key[None].text == "[secret]' x" and by_key[None].n_chars == 11 and by_key[2].text is None and by_key[5].text == LONG


@pytest.mark.parametrize("text, spans", [
    ("key 9fQz7LmX2vB8kTwR4sYp1cHd0 end", "token:4:29"), ("id 123e4567-e89b-12d3-a456-426614174000", ""),
    ("sha1: 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B", ""), ("internationalization1internationalization", ""),
    ("password: short", ""), ("AKIA" + "A" * 12, "access:0:16"), ("x" + "0" * 32 + "g", "hex:1:33"),
])
def test_secret_kinds(text, spans):
    assert secret_scan.joined(secret_scan.Scanner().spans(text)[1]) == spans


def test_fingerprints(spark, docs, none):
    rows = fingerprint.compare_with_edited(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == ALL
    by_key = {r.doc_id: r for r in rows}
    assert by_key[1].fingerprint == by_key[6].fingerprint and by_key[2].fingerprint == by_key[3].fingerprint
    assert fingerprint.compare_with_edited(none).isEmpty()
    one = fingerprint.compare_with_edited(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0
    large = frame(spark, [(2**53 + i, f"text number {i} " * 9) for i in range(40)] + [(None, "n")])
    assert fingerprint.compare_with_edited(large).count() == 41


@given(st.binary(max_size=80), st.binary(max_size=80))
@settings(max_examples=200, deadline=None)
def test_likeness_is_bounded(a, b):
    x, y = fingerprint.digest(a), fingerprint.digest(b)
    assert 0 <= fingerprint.likeness(x, y) <= 1 and fingerprint.likeness(x, x) == 1 and fingerprint.likeness(x, y) == fingerprint.likeness(y, x)


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
def test_decontamination(docs, none, benchmark, block_bytes):
    rows = {r.doc_id: r for r in decontaminate.add_hits(docs, benchmark, block_bytes=block_bytes).collect()}
    # the word of the item without an id is hit, too
    assert [(h.first, h.past) for h in rows[1].hit_ranges] == [(0, 1), (2, 13)] and rows[1]["items"] == ["1"]
    assert rows[2].n_words == rows[3].n_words == 0 and rows[5].hit_ranges == []
    assert decontaminate.add_hits(none, benchmark, block_bytes=block_bytes).isEmpty()
    left = decontaminate.clean_documents(docs, benchmark, block_bytes=block_bytes)
    assert left.schema == docs.schema and {r.doc_id for r in left.collect()} == {2, 3, 4, 5, 7, 9, None}
    assert decontaminate.clean_documents(docs, benchmark.limit(0)).count() == len(TEXTS)


def test_decontamination_offsets(spark, benchmark):
    text = "É-alpha, Gamma--DELTA epsilon zeta eta theta iota kappa lambda mu ü"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = decontaminate.hit_spans(docs, benchmark).first().spans
    # the item without an id holds "alpha"; passages that touch are one span
    assert [text[b:e] for b, e in spans] == ["alpha, Gamma--DELTA epsilon zeta eta theta iota kappa lambda mu"]


def test_pii(docs, none):
    rows = pii.find_pii(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == ALL
    by_key = {r.doc_id: r for r in rows}
    assert [(s.start, s.kind, s.end) for s in by_key[7].base] == [(b, k, e) for b, k, _, e in sorted(pii_base(TEXTS[6][1]))]
    assert pii.find_pii(none).isEmpty()


def test_pii_base_on_odd_texts(spark):
    texts = [
        "a@b.c_d@e.f.g q@ éé a@b@c.d @x.y a..b@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.003.255 1..2", "4785 3805-9239 1139 4539578763621486 12-",
        "+1 (487) 555-7209+44 20 7946 0958. ++1 2", "😀 +12345678901234567 +1234567890", "a@b" + ".c" * 2000, "1" * 2000, "1 " * 2000,
        "x" * 2000 + "@", "+1" + "(" * 2000, "+1" * 2000, "a@" * 2000, "1." * 2000, "a1@b.c" * 300,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        want = [(b, k, e) for b, k, _, e in sorted(pii_base(texts[r.doc_id]))]
        assert [(s.start, s.kind, s.end) for s in r.base] == want, texts[r.doc_id][:40]


def test_pii_on_long_junk(spark):
    texts = ["a@b" + ".c" * 50_000, "1" * 100_000, "1 " * 20_000, "x" * 100_000 + "@", "+1" + "(" * 100_000, "+1" * 50_000,
             "a@" * 50_000, "1." * 50_000, "a1@b.c " * 5_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert [got[i].n_email for i in (0, 3, 6, 8)] == [1, 0, 0, 5_000] and got[7].n_ip == 12_500
    assert time.time() - start < 120


def test_pii_bootstrap_finds_unseen_identifiers(spark):
    seeds = [(i, f"We saw that contact address user{i}@mail.example.com was there") for i in range(6)]
    new = [(100, "and so contact address QX-77812-B was used"), (101, "room number 17 is free")]
    docs = spark.createDataFrame(seeds + new, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert [s.body for s in rows[100].found] == ["QX-77812-B"] and not rows[101].found
    assert "Python" not in pii.find_pii(docs)._jdf.queryExecution().toString()


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    by_key = {r.doc_id: r.component_id for r in rows}
    assert by_key[6] == 1 and by_key[3] == by_key[4] == by_key[2] == 2 and by_key[7] == 7
    assert simhash.near_duplicates(none).isEmpty()
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema and keys(kept) == [(False, 1), (False, 2), (False, 5), (False, 7), (False, 9), (True, 0)]
    assert simhash.keep_one(none).isEmpty()


def test_simhash_links_through_many_shards(spark):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 900).tolist()
    for i in range(600):  # chains and clusters around earlier fingerprints
        base = fps[rng.integers(0, 40 if i % 2 else len(fps))]
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            base ^= 1 << int(b)
        fps.append(base)
    fps = sorted(set(fps))
    want = brute_components({f: f for f in fps})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = simhash.links(table, members=40, chunk=16, sample=300)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    groups, expected = {}, {}
    for f, s in zip(fps, signed):
        groups.setdefault(got.get(s, s), set()).add(f)
        expected.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@given(st.text(st.sampled_from("ab B\t\x0b\x1cé\u00a0"), max_size=40))
@settings(max_examples=150, deadline=None)
def test_simhash_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_urls(spark):
    made = ["http://WWW.Example.com/en/x?q", "https://a.example.com/en/", "http://x.com", "ftp://spam-farm.example.org:80/", "nothing", None, "",
            "https://blog.spam-farm.example.org/a#b", "x://y://z.net/es/1", "//net/es/", "http://u.net/fr/?a=/", "http://example.com/en\n/"]
    pages = spark.createDataFrame([(i, u, u, u) for i, u in enumerate(made)], "page_id long, url string, host string, listed string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    assert rows == {
        0: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 1: ("a.example.com", "/en/", "example.com/en/", "block"),
        2: ("x.com", "", None, "allow"), 3: ("spam-farm.example.org:80", "/", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("blog.spam-farm.example.org", "/a", None, "block"), 8: ("y:", "//z.net/es/1", None, "allow"),
        9: ("", "", None, "allow"), 10: ("u.net", "/fr/", "net/fr/", "block"), 11: ("example.com", "/en\n/", "com/", "allow"),
    }
    assert urls.judge_urls(pages.limit(0)).isEmpty()
    listed = spark.createDataFrame([("u.net/fr/",), ("z.org",), (None,), ("z.org",)], "entry string")
    for size in (1 << 20, 1):
        assert {r.page_id for r in urls.judge_urls(pages, entries=listed, block_bytes=size).collect() if r.listed} == {10}
    long = spark.createDataFrame([(1, "http://" + "a." * 50_000 + "z.org/" + "p" * 100_000)], "page_id long, url string")
    assert urls.judge_urls(long, entries=listed).first().verdict == "block"


def digest_array(tmp_path, entries):
    rows = sorted({(int(np.uint64(urls.digest_of(e.encode())).astype(np.int64)), e) for e in entries})
    path = tmp_path / "digests"
    path.write_bytes(urls.file_of(pa.table({"digest": pa.array([d for d, _ in rows], pa.int64()), "entry": pa.array([e for _, e in rows], pa.string())})))
    return urls.DigestArray(str(path), len(rows))


def test_digest_collisions_are_confirmed(monkeypatch, tmp_path):
    monkeypatch.setattr(urls, "digest_of", lambda b: len(b))
    array = digest_array(tmp_path, ["aa", "bb", "ccc"])
    assert array.contains(["aa", "bb", "cc", "ccc", "ddd", "a"]).tolist() == [True, True, False, True, False, False]
    assert not digest_array(tmp_path, []).contains(["a"]).any()


def test_digests_are_those_of_spark(spark, tmp_path):
    names = [f"host{n}.example.org" for n in range(500)] + ["é.org", ""]
    table = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "entry string")
    assert {r.d for r in table.where("entry is not null").selectExpr("xxhash64(entry) as d").collect()} == {
        int(np.uint64(urls.digest_of(n.encode())).astype(np.int64)) for n in names}
    blocks = list(urls.list_blocks(table, 2000))
    assert len(blocks) > 5 and sum(size for _, size in blocks) == len(names)
    found = []
    for data, size in blocks:
        (tmp_path / "block").write_bytes(data)
        found.append(urls.DigestArray(str(tmp_path / "block"), size).contains([*names, "other.org"]))
    assert np.sum(found, 0).tolist() == [1] * len(names) + [0]


def test_sharding(spark, docs, none, tmp_path):
    rows = sharding.shard_documents(docs)
    assert keys(rows) == ALL and sharding.shard_documents(none).isEmpty()
    repeated = [(r.shard, r.slot) for r in rows.collect() if r.doc_id == 7]
    assert len({s for s, _ in repeated}) == 1 and len(set(repeated)) == 2
    keyed = spark.range(400).selectExpr("id - 200 as k", "xxhash64(id - 200) as h")
    for n in (1, 2, 16, 100):
        got = keyed.select("h", sharding.jump_hash(keyed.h, n).alias("s")).collect()
        assert all(r.s == jump(r.h % 2**64, n) for r in got)
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(TEXTS)


def test_pipeline_on_odd_and_empty_tables(spark, docs, none, tmp_path):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 1)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(1, "gamma delta epsilon")], "item_id long, text string")
    for name, table in (("odd", docs), ("none", none)):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        for stage in corpus_pipeline.STAGES[:4]:
            assert stage[1](spark, table, folder).columns == table.columns
        out = corpus_pipeline.run(spark, folder)
        assert out.isEmpty() == (name == "none")


def test_pipeline_stages_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/documents.parquet")
    docs = {r.doc_id: r.text for r in source.collect()}
    fps = {k: brute_fingerprint(t) for k, t in docs.items()}
    roots = brute_components(fps)
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, source, folder).collect()} == {k for k in docs if roots[k] == k}
    from tests.llm.test_contracts import ASSIGN

    for r in corpus_pipeline.secret_stage(spark, source, folder).collect():
        left = [m for m in ASSIGN.finditer(r.text) if len(m[2]) >= 8] + [m for m in re.finditer("[0-9a-f]{32,}", r.text)]
        assert not left and r.n_chars == len(r.text)
        if r.text == docs[r.doc_id]:
            continue
        assert "[secret]" in r.text
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, source, folder).collect()}
    good = [k for k in quality_of if quality_of[k] == 1]
    assert sum(k in kept for k in good) >= 0.95 * len(good)
