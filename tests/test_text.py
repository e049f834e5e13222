import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from presswork.functions import text as txt
from presswork.operators import words

TEXTS = [
    None,
    "",
    "?!, ;",
    "...",
    "Giá vàng hôm nay tăng 3,5% so với 12.5 USD. Ông Đặng Văn A. nói: \"Không!\"\nHà Nội.",
    unicodedata.normalize("NFD", "Tiếng Việt có dấu. Đẹp"),
    "a\xa0b\x1cc　d. e\x85f",
    "x.y z.. w...\n\n. q",
    "A. B! C? D",
    "  led by blanks. And ended  \n ",
    "under_score 1_2 _ 42 x1",
    "tail dot.\xa0",
    "İstanbul ΑΣ ẞ",
]


def split_python(text):
    """Plain Python version of the sentence and word rules."""
    stripped = re.sub(r"[^\w\s.]", "", text)
    found = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", stripped):
        tokens = [t for t in re.split(r"\s+", re.sub(r"\.+\s*\Z", " .", sentence)) if t]
        if tokens:
            found.append(tokens)
    return found


def kept_python(text):
    return [t.lower() for s in split_python(text) for t in s if any(c.isalpha() for c in t)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").cache()


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_sentence_words_match_python(texts):
    got = by_id(texts.select("id", txt.sentence_words(F.col("text")).alias("s")), "s")
    for i, text in enumerate(TEXTS):
        assert got[i] == (None if text is None else split_python(text)), text


def test_kept_words_match_python_and_the_general_path(texts):
    # an extra tag that no rule gives selects the general path
    columns = texts.select(
        "id", txt.kept_words(F.col("text")).alias("fast"),
        F.transform(F.filter(txt.words(txt.strip_chars(F.col("text"))), lambda t: txt.is_kept(t)), F.lower).alias("general"))
    for row in columns.collect():
        text = TEXTS[row["id"]]
        want = None if text is None else kept_python(text)
        assert row["general"] == row["fast"] == want, text


def test_drop_set_is_a_parameter(texts):
    got = by_id(texts.select("id", txt.processed_text(F.col("text"), drop_tags=("CH",)).alias("p")), "p")
    assert got[10] == "under_score 1_2 42 x1"
    assert by_id(texts.select("id", txt.processed_text(F.col("text")).alias("p")), "p")[10] == "under_score x1"


def test_nothing_kept_is_empty_and_null_stays_null(texts):
    got = by_id(words.preprocess(texts, "id", "text"), "processed_content")
    assert got[0] is None and got[1] == "" and got[2] == "" and got[3] == ""


def test_tables_path_agrees_with_rules(texts):
    plain = by_id(words.preprocess(texts, "id", "text"), "processed_content")
    assert by_id(words.preprocess_with_tables(texts, "id", "text"), "processed_content") == plain


def test_lexicon_overrides_rules(spark):
    docs = spark.createDataFrame([(1, "The cat saw 7 dogs.")], "id long, text string")
    lexicon = spark.createDataFrame([("The", "X"), ("7", "N")], "token string, tag string")
    got = by_id(words.preprocess_with_tables(docs, "id", "text", lexicon=lexicon), "processed_content")
    assert got[1] == "cat saw 7 dogs"


def test_phrases_merge_left_to_right_without_overlap(spark):
    docs = spark.createDataFrame([(1, "a a a a a b. a b c\nc a a")], "id long, text string")
    phrases = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "w1 string, w2 string")
    merged = words.merge_tokens(words.token_table(docs, "id", "text"), phrases, "id")
    got = [r["token"] for r in merged.orderBy("sent", "pos").collect()]
    assert got == ["a_a", "a_a", "a_b", ".", "a_b", "c", "c", "a_a"]
    more = docs.unionByName(spark.createDataFrame([(2, None), (3, ""), (4, "a"), (5, ". b a b c")], docs.schema))
    rows = more.select("id", txt.sentence_words(F.col("text")).alias("s"))
    ways = [by_id(words.apply_phrases(rows, "id", "s", phrases, fits=fits), "merged") for fits in (True, False)]
    assert ways[0] == ways[1] and sum(ways[0][1], []) == got and ways[0][2] is None and ways[0][3] == []


def test_learn_phrases_brute_force(spark):
    texts = ["new york is big. new york is far"] * 4 + ["new car. york is"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = words.learn_phrases(words.token_table(docs, "id", "text"), min_count=3, threshold=0.5, discount=2.0).collect()
    singles, pairs = {}, {}
    for text in texts:
        for tokens in split_python(text):
            for i, t in enumerate(tokens):
                singles[t] = singles.get(t, 0) + 1
                if i + 1 < len(tokens):
                    pairs[t, tokens[i + 1]] = pairs.get((t, tokens[i + 1]), 0) + 1
    total = sum(singles.values())
    want = {
        p: (n - 2.0) * total / (singles[p[0]] * singles[p[1]]) for p, n in pairs.items()
        if n >= 3 and (n - 2.0) * total / (singles[p[0]] * singles[p[1]]) > 0.5
    }
    assert {(r["w1"], r["w2"]): r["score"] for r in rows} == pytest.approx(want)
    assert all(r["n1"] == singles[r["w1"]] and r["n2"] == singles[r["w2"]] for r in rows)


def test_quality_counts(texts):
    got = {r["id"]: r for r in words.preprocess_quality(texts, "id", "text").collect()}
    assert got[0]["n_sentences"] in (None, -1) or got[0]["n_tokens"] is None
    for i, text in enumerate(TEXTS):
        if text is not None:
            found = split_python(text)
            dropped = sum(not any(c.isalpha() for t in s for c in t) for s in found)
            assert (got[i]["n_sentences"], got[i]["n_dropped_sentences"]) == (len(found), dropped)
            assert (got[i]["n_tokens"], got[i]["n_kept"]) == (sum(map(len, found)), len(kept_python(text)))


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("html, want", [
    ("<h1>Caf&eacute; &amp; th&eacute; ngon</h1>", "Café & thé ngon"),
    ("it&apos;s &#000000233; &#x000000E9;", "it's é é"),
    ("a <b>c <!-- x --> d <!-- e <script>f", "a c d f"),
    ("x <!-- y <script z", "x <!-- y <script z"),
    ("<SCRIPT>x</style >y<style>z", "y z"),
    ("a<script>var t='</p>';</script><style>p{}</style><!-- x -->b", "a b"),
    ("1 &lt; 2 &amp;lt; 3", "1 < 2 &lt; 3"),
    ("&#233;&#xE9;&#8364;&#x1F600;&#0;", "éé€😀&#0;"),
    ("AT&T &unknown; &; & x", "AT&T &unknown; &; & x"),
    ("no markup", "no markup"),
    ("", ""),
    (None, None),
])
def test_clean_html(spark, html, want):
    assert one(spark, txt.clean_html(F.col("h")), h=html) == want


@pytest.mark.parametrize("text, want", [
    ("see https://a.b/c?d=1 or www.x.vn now", "see or now"),
    ("mail a.b+c@d-e.com.vn, x@y", "mail , x@y"),
    ("a@b.com_x@y.org end", "end"),
    ("1,000.5 and 3.", "and ."),
])
def test_scrub(spark, text, want):
    assert one(spark, txt.scrub_links_emails_numbers(F.col("t")), t=text) == want


def test_fold_accents(spark):
    assert one(spark, txt.fold_accents(F.col("t")), t="Pháp luật Đời sống Thế giới ướ") == "Phap luat Doi song The gioi uo"


@pytest.mark.parametrize("junk", ["." * 300_000 + "a", " " * 300_000 + "a", "1," * 300_000 + "a", "x" * 300_000, "7" * 300_000])
def test_long_junk_runs_take_linear_time(spark, junk):
    start = time.time()
    frame = spark.createDataFrame([(junk,)], "t string")
    frame.select(
        txt.processed_text(F.col("t")), F.size(txt.sentence_words(F.col("t"))), txt.trim_spaces(F.col("t")),
        txt.scrub_links_emails_numbers(F.col("t"))).collect()
    assert time.time() - start < 20


@pytest.mark.parametrize("junk", ["<" * 300_000, "<!--" * 75_000, "<script>" * 40_000, "&" * 300_000, "</script " * 35_000, "&#1" * 100_000,
                                  "<!--" * 75_000 + "-->", "<style>" * 40_000 + "</style>"])
def test_html_junk_takes_linear_time(spark, junk):
    frame = spark.createDataFrame([(junk,)], "h string")
    start = time.time()
    frame.select(txt.clean_html(F.col("h"))).collect()
    assert time.time() - start < 20
