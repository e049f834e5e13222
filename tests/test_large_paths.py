"""Ways taken beside large word tables, forced on small ones, against those inside the rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presswork.functions import text as txt
from presswork.operators import bayes, counting, mapped, scale, segment, tagging, words

RNG = random.Random(7)
TEXTS = [" ".join(RNG.choice(["hà", "nội", "đẹp", "a1", "b", "c.", "d\n", "e", "12", "_", ".", "f!"]) for _ in range(RNG.randint(1, 30)))
         for _ in range(60)] + [None, "", "..", "hà nội hà nội"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i or None, t) for i, t in enumerate(TEXTS)]  # one null key
    frame = spark.createDataFrame(rows, "id long, text string")
    return frame.select("id", "text", txt.sentence_words(F.col("text")).alias("sentences"), txt.kept_words(F.col("text")).alias("words")).cache()


def _same(a, b):
    key = lambda r: (r["id"] is None, r["id"] or 0)
    assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)


def test_hash_filter_is_bounded_and_misses_nothing(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    assert scale.hash_bits(keys, "h", 1 << 16).nbytes == 1 << 13
    listed = scale.hash_filter(keys, "h")
    assert keys.filter(~listed(F.col("h"))).isEmpty()
    assert spark.range(5000, 15000).filter(listed(F.xxhash64("id"))).count() < 2000
    assert spark.range(3).filter(scale.hash_filter(keys.limit(0), "h")(F.col("id"))).isEmpty()


def test_runs_are_counted_whole(docs):
    want = Counter()
    for row in docs.collect():
        for tokens in row.sentences or []:
            for i in range(len(tokens)):
                for k in range(1, min(4, len(tokens) - i) + 1):
                    run = tokens[i:i + k]
                    if k == 1 or all(any(c.isalpha() for c in t) for t in run):
                        want[" ".join(run), k] += 1
    got = {(r.word, r.length): r.n for r in segment.ngram_counts(docs, "sentences", 4, 3).collect()}
    assert got == {w: n for w, n in want.items() if w[1] == 1 or n >= 3}


def test_rare_pairs_are_not_stored(docs, monkeypatch):
    stored = {}
    monkeypatch.setattr(words, "materialise", lambda df, label: stored.setdefault(label, df.localCheckpoint()))
    words.learn_phrases(words.token_table(docs, "id", "text"), min_count=5, threshold=0.0)
    seen = stored["pair-hashes"].count()
    assert 0 < stored["phrase-counts"].filter("w2 is not null").count() <= seen + 2


def test_segment_with_a_large_lexicon(docs, monkeypatch):
    lexicon = segment.learn_lexicon(docs, "sentences", min_count=3).cache()
    inside = segment.segment(docs.select("id", "sentences"), "id", "sentences", lexicon, fits=True)
    for cut in (1, 60, None):
        monkeypatch.setattr(segment, "count_cut", lambda table, weight, cut=cut: cut)
        _same(inside, segment.segment(docs.select("id", "sentences"), "id", "sentences", lexicon, fits=False))


def test_encode_with_a_large_vocabulary(docs, monkeypatch):
    vocab = words.build_vocab(docs, "words").filter("token <> 'b'").cache()
    inside = words.encode_tokens(docs, "id", "words", vocab, fits=True)
    for cut in (1, 60, None):
        monkeypatch.setattr(words, "count_cut", lambda table, weight, cut=cut: cut)
        _same(inside, words.encode_tokens(docs, "id", "words", vocab, fits=False))


def test_merging_beside_many_phrases(docs):
    phrases = words.learn_phrases(words.token_table(docs, "id", "text"), min_count=3, threshold=0.1, discount=1.0).cache()
    assert phrases.count() > 3
    sentences = docs.select("id", "sentences")
    _same(words.apply_phrases(sentences, "id", "sentences", phrases, fits=True), words.apply_phrases(sentences, "id", "sentences", phrases, fits=False))


def test_processing_inside_the_rows(spark, docs):
    lexicon = spark.createDataFrame([("hà", "X"), ("12", "N"), ("nội", "N")], "token string, tag string")
    given = docs.select("id", "text")
    found = words.preprocess_with_tables(given, "id", "text", None, lexicon)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    marked = docs.select("id", F.col("sentences").alias("_sentences"))
    _same(found, words._kept_by_key(marked, "id", lexicon, words.DROP_TAGS))
    twice = given.union(given.filter("id > 50"))  # texts of a repeated key become one row, as before
    both = docs.select("id", "sentences").union(docs.select("id", "sentences").filter("id > 50")).withColumnRenamed("sentences", "_sentences")
    _same(words.preprocess_with_tables(twice, "id", "text", None, lexicon), words._kept_by_key(both, "id", lexicon, words.DROP_TAGS))


def test_many_sentences_are_tagged_as_each_alone():
    rng = np.random.default_rng(3)
    first, steps = rng.integers(0, 4, 3), rng.integers(0, 4, (3, 3))
    sizes = rng.integers(1, 9, 40)
    costs = rng.integers(0, 4, (sizes.sum(), 3))
    path, least = tagging.best_tags_of(costs, sizes, first, steps)
    begin = 0
    for size, total in zip(sizes, least):
        own = tagging.best_tags(costs[begin:begin + size], first, steps)
        assert (path[begin:begin + size].tolist(), int(total)) == own
        begin += size


@pytest.fixture(scope="module")
def labelled(docs):
    rows = docs.filter("id is not null").select("id", "words", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("label"),
                                                (F.col("id") % 4).cast("int").alias("kfold"))
    return rows.cache()


def _close(got, want):
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Texts without words, a repeated key, a null key, and words that no model has seen."""
    more = spark.createDataFrame([(1, ["e", "new"]), (None, ["b"]), (200, []), (201, None), (202, [None, "e"])], "id long, words array<string>")
    return docs.select("id", "words").union(more).cache()


def test_bayes_beside_a_large_model(labelled, odd, monkeypatch):
    model = bayes.fit(labelled, "label", "words", ["a", "b"])
    assert model.fits
    want = {r.id: r.logits for r in bayes.score(odd, ["id"], "words", model).collect()}
    for cut in (1, 60, None):
        monkeypatch.setattr(bayes, "count_cut", lambda table, weight, rows, cut=cut: cut)
        scored = bayes.score(odd, ["id"], "words", bayes.BayesModel(model.classes, model.table, model.priors, False))
        _close({r.id: r.logits for r in scored.collect()}, want)


def test_folded_bayes_is_summed_inside_the_rows(labelled, odd, monkeypatch):
    classes = ["a", "b"]
    model = bayes.fit_kfold(labelled, "label", "words", classes, folds=4)
    assert model.fits
    scored = bayes.score_kfold(odd, ["id"], "words", model)
    assert "Generate" not in scored._jdf.queryExecution().optimizedPlan().toString()  # no row per word
    # each fold's model is the one fitted on the other folds alone
    alone = [bayes.fit(labelled.filter(F.col("kfold") != f), "label", "words", classes) for f in range(4)]
    each = [{r.id: r.logits for r in bayes.score(odd, ["id"], "words", m).collect()} for m in alone]
    want = {k: [m[k] for m in each] for k in each[0]}
    _close({r.id: r.model_logits for r in scored.collect()}, want)
    _close({r.id: r.logits for r in scored.collect()}, {k: np.mean(v, axis=0) for k, v in want.items()})
    for cut in (1, 60, None):
        monkeypatch.setattr(bayes, "count_cut", lambda table, weight, rows, cut=cut: cut)
        large = bayes.FoldedBayesModel(model.classes, model.table, model.priors, False)
        _close({r.id: r.model_logits for r in bayes.score_kfold(odd, ["id"], "words", large).collect()}, want)


def test_head_of_a_large_model_is_bounded():
    for cells in (1, 4, 20, 500):
        assert bayes._head_rows(cells) <= scale.BROADCAST_ROWS and bayes._head_rows(cells) * 8 * cells <= scale.BROADCAST_BYTES


def test_merging_with_phrases_in_files(docs, monkeypatch):
    phrases = words.learn_phrases(words.token_table(docs, "id", "text"), min_count=3, threshold=0.1, discount=1.0).cache()
    sentences = docs.select("id", "sentences")
    inside = words.apply_phrases(sentences, "id", "sentences", phrases, fits=True)
    monkeypatch.setattr(mapped, "TOKENS", 40)
    monkeypatch.setattr(mapped, "BLOCK_BYTES", 100)
    beside = words.apply_phrases(sentences, "id", "sentences", phrases, fits=False)
    _same(inside, beside)
    assert "Exchange" not in beside.drop("id")._jdf.queryExecution().executedPlan().toString().replace("Scan", "").split("InMemory")[0]
    monkeypatch.setattr(mapped, "MOST_BYTES", 0)
    _same(inside, words.apply_phrases(sentences, "id", "sentences", phrases, fits=False))


def test_runs_that_share_a_key_are_told_apart(monkeypatch):
    entries = pa.table({"key": np.array([5, 5, 5, 9], np.int64), "word": ["a", "b", "c", "d"], "value": np.array([1, 2, 3, 4], np.int64)})
    monkeypatch.setattr(mapped, "_opened", lambda name: entries.combine_chunks().to_batches()[0])
    asked = pa.array(["c", "a", "x", "d", "b", None])
    place, value = mapped.Files([("", -(1 << 63), (1 << 63) - 1)]).find(np.array([5, 5, 5, 9, 5, 9], np.uint64), lambda at: asked.take(pa.array(at)))
    assert dict(zip(place.tolist(), value.tolist())) == {0: 3, 1: 1, 3: 4, 4: 2}


def test_packed_counts_are_whole(spark, monkeypatch):
    monkeypatch.setattr(counting, "HELD_HASHES", 50)
    monkeypatch.setattr(counting, "HELD_ROWS", 20)
    rows = [(RNG.choice(["", "a", "đ", "ab"]), RNG.choice([None, "x", "yz", ""])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "w1 string, w2 string").repartition(3).select("w1", "w2", F.xxhash64("w1", "w2").alias("_h"))
    got = counting.counted(frame, ["w1", "w2"], lambda b: [pa.table({"w1": b.column(0), "w2": b.column(1), "_h": b.column(2)})])
    assert {(r.w1, r.w2): r.n for r in got.collect()} == Counter(rows)
    often = counting.frequent_hashes(frame, lambda b: [b.column(2).to_numpy().view(np.uint64)], 25)
    mask = (1 << counting.HASH_BITS) - 1
    want = {r._h & mask for r in frame.groupBy("_h").count().filter("count >= 25").collect()}
    assert 0 < len(want) < 16 and {r._h for r in often.collect()} == want


def test_segment_with_a_lexicon_in_files(docs, monkeypatch):
    lexicon = segment.learn_lexicon(docs, "sentences", min_count=3).cache()
    rows = docs.select("id", "sentences")
    inside = segment.segment(rows, "id", "sentences", lexicon, fits=True)
    monkeypatch.setattr(mapped, "TOKENS", 40)
    monkeypatch.setattr(mapped, "BLOCK_BYTES", 200)
    _same(inside, segment.segment(rows, "id", "sentences", lexicon, fits=False))
    monkeypatch.setattr(mapped, "MOST_BYTES", 0)
    for cut in (1, 60, None):
        monkeypatch.setattr(segment, "count_cut", lambda table, weight, cut=cut: cut)
        _same(inside, segment.segment(rows, "id", "sentences", lexicon, fits=False))


def test_many_paths_are_those_of_each_sentence():
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 12, 60)
    tokens = [str(x) for x in rng.integers(0, 3, sizes.sum())]
    known = {" ".join(map(str, rng.integers(0, 3, k))): int(rng.integers(1, 9)) for k in (1, 2, 2, 2, 3, 3, 3, 4, 4) for _ in range(2)}
    ends = np.cumsum(sizes).tolist()
    costs = [np.full(len(tokens), 5 if k == 1 else segment.NOT_LISTED) for k in range(1, 5)]
    for end, size in zip(ends, sizes.tolist()):
        for i in range(end - size, end):
            for k in range(1, min(4, end - i) + 1):
                costs[k - 1][i] = known.get(" ".join(tokens[i:i + k]), costs[k - 1][i])
    begins, total = segment.best_paths(costs, sizes)
    for end, size, least in zip(ends, sizes.tolist(), total.tolist()):
        own = tokens[end - size:end]
        cuts = np.flatnonzero(begins[end - size:end]).tolist() + [size]
        assert (["_".join(own[a:b]) for a, b in zip(cuts, cuts[1:])], least) == segment.best_path(own, known, 5, 4)
