"""Cross-tokenizer alignment against the two tokenizers themselves and all overlapping byte ranges."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from presswork.llm import alignment
from presswork.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in PRINTABLE} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def ranges(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(text):
    """n_a, n_b, n_groups, digest, links."""
    none = (0, 0, 0, "", [])
    if not text:
        return none
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(BYTE_OF[c] for c in A.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return none
    ra, rb = ranges(bytes_a), ranges(bytes_b)
    ends = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, start = [], 0
    for end in ends:
        groups.append(",".join(str(i) for i, (x, y) in zip(a, ra) if start < y <= end) + "|"
                      + ",".join(str(i) for i, (x, y) in zip(b, rb) if start < y <= end))
        start = end
    links = [(i, j) for i, (x, y) in zip(a, ra) for j, (u, v) in zip(b, rb) if max(x, u) < min(y, v)]
    return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def brute_corpus(docs):
    single = [(k, *brute(t)) for k, t in docs]
    count = Counter(p for *_, links in single for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(k, n_a, n_b, n_groups, len(links), digest, sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links))
            for k, n_a, n_b, n_groups, digest, links in single]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op13_tokenizer_alignment"](spark, SF_DIR)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    short = [(r.doc_id, r.text) for r in rows if len(r.text or "") < 4000]
    got = {r.doc_id: tuple(r) for r in found.collect()}
    assert len(got) == len(rows) and len(short) > 100
    for row in [(k, *brute(t)) for k, t in short]:
        assert got[row[0]][1:4] == row[1:4] and got[row[0]][4:6] == (len(row[5]), row[4])


DOCS = [(1, "Hello, wörld! it's fine\nnext line"), (2, None), (3, ""), (4, " leading"), (5, "two  blanks"), (6, "trailing "), (7, "\n\n\tx"),
        (8, "<|endoftext|> <s> </s> <0x41> <unk>"), (9, "中文 ﬁ ² ①   　 ﻿"), (10, "a\x00b ▁x"), (11, "é café"),
        (None, "Hello, hello"), (13, "Hello, hello"), (13, "Hello, hello"), (14, "😀👍🏽 naïve"), (15, "internationalization antidisestablishmentarianism")]


@pytest.mark.parametrize("head_pairs", [0, 3, 20, alignment.HEAD_PAIRS])
def test_every_way_to_the_counts(spark, head_pairs):
    docs = spark.createDataFrame([(k, t, "x", "y", 1) for k, t in DOCS], "doc_id long, text string, n_a string, _row string, link_a int")
    assert result(alignment.align_documents(docs, head_pairs=head_pairs)) == sorted(brute_corpus(DOCS), key=str)
    assert alignment.align_documents(docs.limit(0), head_pairs=head_pairs).isEmpty()


def of_text(aligner, texts):
    return [(n_a, n_b, n_groups, digest, sorted(zip((links >> 32).tolist(), (links & 0xFFFFFFFF).tolist())))
            for n_a, n_b, n_groups, digest, links in aligner.documents(texts)]


ALIGNER = alignment.Aligner(cache_words=500)
WORDS = st.lists(st.sampled_from(["the", "ciónñ", "don't", "'s", "x-1_y", "Élan", "<|endoftext|>", "...", "a" * 40, "12345", "§x"]), max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(codec="utf-8"), max_size=40), st.text("abcé1.,' \n-<|>", max_size=40), WORDS.map(" ".join),
                          WORDS.map("\n".join)), max_size=6))
def test_texts(texts):
    want = [(*b[:4], sorted(b[4])) for b in map(brute, texts)]
    assert of_text(ALIGNER, texts) == want  # word by word where that is possible
    assert of_text(alignment.aligner(alignment.VOCABULARY_A, alignment.VOCABULARY_B), texts) == want


def test_words_and_whole_texts_agree_and_the_cache_is_emptied():
    texts = [" ".join(f"w{n * 7 % 900}é{n}" for n in range(start, start + 300)) for start in range(0, 3000, 150)] * 2
    own, whole = alignment.Aligner(cache_words=1000), alignment.Aligner(cache_words=0)
    found = [row for t in texts for row in of_text(own, [t])]
    assert found == of_text(whole, texts) and len(own.number) <= 1300


@pytest.mark.parametrize("text", ["wörd one2 a.b " * 30_000, "a" * 300_000, " " * 100_000, "." * 100_000 + "é"])
def test_long_texts(text):
    n_a, n_b, n_groups, digest, links = next(iter(ALIGNER.documents([text])))
    assert len(links) == n_a + n_b - n_groups and n_groups > 0 and digest
