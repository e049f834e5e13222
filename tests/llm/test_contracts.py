"""Each numbered query against a plain, slow version of its contract, over whole small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from presswork.llm import licenses
from presswork.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def rows_of(spark, name):
    return QUERIES[name](spark, SF_DIR).collect()


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{b}:{e}" for b, _, k, e in sorted(spans)).encode()).hexdigest()


def license_scan(text):
    """Every window of every template by plain counting; of overlapping ones the one with most in common, then the better, then the earlier."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    spans = [(m[0].replace("licence", "license") if m[0] == "licence" else m[0], m.start(), m.end()) for m in re.finditer("[a-z0-9]+", low)]
    grams = list(zip([w for w, _, _ in spans], [w for w, _, _ in spans][1:]))
    able = []
    for k, (name, body) in enumerate(licenses.TEMPLATES.items()):
        t = [m.replace("licence", "license") if m == "licence" else m for m in re.findall("[a-z0-9]+", body.lower())]
        bag = Counter(zip(t, t[1:]))
        m = sum(bag.values())
        size = min(m, len(grams))
        if not size or not bag.keys() & set(grams):
            continue
        for at in range(len(grams) - size + 1):
            common = sum((Counter(grams[at:at + size]) & bag).values())
            score = 2 * common / (size + m)
            if score >= licenses.THRESHOLD:
                able.append((-common, -score, at, k, size, name.partition("#")[0]))
    stay = []
    for _, score, at, k, size, name in sorted(able):
        if all(at > b or at + size < a for a, b, *_ in stay):
            stay.append((at, at + size, k, -score, name))
    return [(name, score, spans[a][1], spans[b][2]) for a, b, k, score, name in sorted(stay, key=lambda s: (s[2], s[0]))]


def test_op1(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op1_license_scan")}
    assert set(got) == set(docs)
    short = {k: t for k, t in docs.items() if len(t) < 3000}
    for key, text in short.items():
        want = license_scan(text)
        assert got[key].licenses == ",".join(dict.fromkeys(n for n, *_ in want))
        assert got[key].spans == ",".join(f"{n}:{b}:{e}" for n, _, b, e in want)
        assert got[key].best_score == (round(max(s for _, s, _, _ in want), 6) if want else None)
    assert sum(bool(got[k].licenses) for k in short) > 0


def test_op2(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for key, text in docs.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4")
            want[key, piece] = (at, len(part), zlib.crc32(part.tobytes()))
    rows = rows_of(spark, "op2_best_fit_packing")
    assert len(rows) == len(want)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(n for _, n, _ in want.values()) // 4096) + 2


def test_op3(spark, docs):
    rows = {r.doc_id: r for r in rows_of(spark, "op3_quality_classifier")}
    assert set(rows) == set(docs)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in rows.items())
    assert all(r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [k for k in quality if rows[k].held_out]
    assert held and np.mean([rows[k].predicted == quality[k] for k in held]) >= 0.85


ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_op4(spark, docs):
    for r in rows_of(spark, "op4_secret_scan"):
        t = docs[r.doc_id]
        assign = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        access = [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        hexes = [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert (r.n_assign, r.n_access, r.n_hex) == (len(assign), len(access), len(hexes))
        assert r.base_sha256 == digest(assign + access + hexes)
        assert {f"{k}:{b}:{e}" for b, _, k, e in assign + access + hexes} <= set(r.spans.split(","))


def test_op5(spark, docs):
    order = sorted(docs)
    rows = {r.doc_id: r for r in rows_of(spark, "op5_quartile_fingerprint")}
    assert sorted(rows) == order
    by_text = {}
    for i, key in enumerate(order):
        t, after, r = docs[key], order[(i + 1) % len(order)], rows[key]
        n = len(t)
        edited = t[:n - n // 4] + docs[after][:n // 4]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert (t != docs[after]) or r.near_next == 1
    assert np.mean([r.near_edited > r.near_next or docs[k] == docs[order[(i + 1) % len(order)]]
                    for i, (k, r) in enumerate((k, rows[k]) for k in order)]) > 0.95


def test_op6(spark, docs):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    windows = {}
    for item, w in items.items():
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    some = 0
    for r in rows_of(spark, "op6_benchmark_decontamination"):
        w, hit, found = words(docs[r.doc_id]), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i:i + size]))
                if own:
                    found |= own
                    hit.update(range(i, i + size))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        some += bool(hit)
    assert some


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def pii_base(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_op7(spark, docs):
    for r in rows_of(spark, "op7_pii_bootstrap"):
        base = pii_base(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in base) for k in range(4)]
        assert r.base_sha256 == digest(base)
        assert {f"{k}:{b}:{e}" for b, _, k, e in base} <= set(r.spans.split(","))


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    keys = sorted(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_op8(spark, docs):
    fps = {k: brute_fingerprint(t) for k, t in docs.items()}
    want = brute_components(fps)
    rows = rows_of(spark, "op8_simhash_near_duplicates")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{fps[k]:016x}", want[k]) for k in docs}
    assert len(rows) == len(docs)


def jump(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_op10(spark, docs):
    rows = rows_of(spark, "op10_jump_hash_shards")
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    slots = {}
    for r in rows:
        data = docs[r.doc_id].encode()
        key = xxhash.xxh64_intdigest(int(r.doc_id).to_bytes(8, "little", signed=True), 42)
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (jump(key, 16), jump(key, 17)) and r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
