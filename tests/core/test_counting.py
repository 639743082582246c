import math

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.functions.errors import IncompatibleValue, NotAllowedValue, OutOfVocabulary, RequiredValue
from lexigrid.operators import context as X
from lexigrid.operators import counts as K
from lexigrid.operators import matrix as M
from lexigrid.operators import weighting as W
from lexigrid.operators.cooccurrence import count_cooccurrence, merge
from lexigrid.sources import corpus as S

SENTENCES = [
    "Beautiful is better than ugly", "Explicit is better than implicit", "Simple is better than complex",
    "Complex is better than complicated", "Flat is better than nested", "Sparse is better than dense",
]
ROWS, COLUMNS = ["beautiful", "ugly", "simple", "complex", "complicated"], ["is", "better", "than"]


@pytest.fixture(scope="module")
def corpus(spark):
    return S.from_iterable(spark, SENTENCES, lower=True).cache()


def grid(df, rows=ROWS, columns=COLUMNS):
    have = {(r.word, r.ctx): r.n for r in df.collect()}
    return [[have.get((w, c), 0) for c in columns] for w in rows]


def vocab(spark, words):
    return K.vocabulary(spark, words)


@pytest.mark.parametrize(
    "size, want", [(1, [[1, 0, 0], [0, 0, 1], [1, 0, 0], [1, 0, 1], [0, 0, 1]]), (2, [[1, 1, 0], [0, 1, 1], [1, 1, 0], [1, 2, 1], [0, 1, 1]])]
)
def test_windows(spark, corpus, size, want):
    got = count_cooccurrence(corpus, vocab(spark, ROWS), X.Window(size), vocab(spark, COLUMNS))
    assert grid(got) == want


def test_dirty_window_skips_unknown_words(spark, corpus):
    got = count_cooccurrence(corpus, vocab(spark, ["beautiful", "simple", "complex"]), X.Window(1, dirty=True), vocab(spark, ["ugly", "complex", "complicated"]))
    assert grid(got, ["beautiful", "simple", "complex"], ["ugly", "complex", "complicated"]) == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_discovered_contexts(spark, corpus):
    got = count_cooccurrence(corpus, vocab(spark, ROWS))
    assert {r.ctx for r in got.collect()} == {"is", "than"}
    got = count_cooccurrence(corpus, vocab(spark, [*ROWS, "is"]))
    assert got.select("ctx").distinct().count() == 9


def test_words_are_required(corpus):
    with pytest.raises(RequiredValue):
        count_cooccurrence(corpus, None)


FOX = "The quick brown fox jumps over the lazy dog"
FOX_VOCAB = ["quick", "brown", "fox", "lazy", "dog"]


def contexts(spark, window, words=None, vocab_=FOX_VOCAB):
    s = S.from_iterable(spark, [FOX])
    rows = window(s, words and vocab(spark, words), vocab_ and vocab(spark, vocab_)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.pos, getattr(r, "dist", 0) if "dist" in r.asDict() else 0, r.ctx)):
        out.setdefault(r.pos, []).append((r.ctx, r.dist) if "dist" in r.asDict() else r.ctx)
    return out


def test_asymmetric_distance_and_ngram_windows(spark):
    assert contexts(spark, X.Window((0, 2), distance=True))[0] == [("quick", 1), ("brown", 2)]
    # offsets are true ones also where the sentence's begin cuts the window
    assert contexts(spark, X.Window((3, 0), distance=True))[2] == [("quick", -1)]
    assert contexts(spark, X.Window((3, 0), distance=True))[3] == [("quick", -2), ("brown", -1)]
    grams = contexts(spark, X.Window(3, n_grams=2, distance=True))
    assert grams[0] == [("quick brown", 1), ("brown fox", 2)]
    assert grams[4] == [("quick brown", -2), ("brown fox", -1)]
    assert 6 not in {p for p, c in grams.items() if ("jumps over", -1) in c}


def test_dynamic_windows_are_seeded_and_bounded(spark):
    a, b = contexts(spark, X.Window(3, dynamic=True, seed=4), vocab_=None), contexts(spark, X.Window(3, dynamic=True, seed=4), vocab_=None)
    wide = contexts(spark, X.Window(3), vocab_=None)
    assert a == b and all(set(a[p]) <= set(wide[p]) for p in a) and a != wide
    assert contexts(spark, X.Window(0, dynamic=True), vocab_=None) == {}
    with pytest.raises(NotAllowedValue):
        X.Window(-1)


def test_sentence_contexts(spark):
    s = S.from_iterable(spark, ["a b a", "a", ""])
    rows = sorted((r.sent_id, r.pos, r.ctx) for r in X.Sentence()(s).collect())
    assert rows == [(0, 0, "a"), (0, 0, "b"), (0, 1, "a"), (0, 1, "a"), (0, 2, "a"), (0, 2, "b")]
    got = {(r.word, r.ctx): r.n for r in count_cooccurrence(s, vocab(spark, ["a", "b"]), X.Sentence()).collect()}
    assert got == {("a", "a"): 2, ("a", "b"): 2, ("b", "a"): 2}


def test_custom_context(spark):
    s = S.from_iterable(spark, ["a b", "c"])
    got = X.Custom(lambda tokens: [[t.upper()] for t in tokens])(s, vocab(spark, ["a", "c"]))
    assert sorted((r.word, r.ctx) for r in got.collect()) == [("a", "A"), ("c", "C")]


def test_bigrams_in_sentences(spark):
    s = S.from_iterable(spark, ["i love new york"])
    v = vocab(spark, ["i", "love", ("new", "york")])
    assert grid(count_cooccurrence(s, v, X.Window(1), v), ["i", "love", "new york"], ["i", "love", "new york"]) == [[0, 1, 0], [1, 0, 1], [0, 1, 0]]
    s = spark.createDataFrame([(0, 0, list("aaabc")), (0, 1, ["a"]), (1, 0, []), (1, 1, ["a", None, "a", "a"])], "doc_id int, sent_id int, tokens array<string>")
    listed = spark.createDataFrame([("a a",), ("x y",)], "word string")
    want = [["a a", "a", "b", "c"], ["a"], [], ["a", None, "a a"]]
    assert [r.tokens for r in K.merge_bigrams(s, listed).orderBy("doc_id", "sent_id").collect()] == want


def test_merge_with_keys(spark):
    a = spark.createDataFrame([("x", "c", 1), ("y z", "c", 2)], "word string, ctx string, n long")
    assert {(r.word, r.ctx): r.n for r in merge(a, a).collect()} == {("x", "c"): 2, ("y z", "c"): 4}
    keyed = {(r.word, r.ctx): r.n for r in merge(a, a, word_keys=["en", "fr"]).collect()}
    assert keyed == {("en_x", "c"): 1, ("en_y en_z", "c"): 2, ("fr_x", "c"): 1, ("fr_y fr_z", "c"): 2} or keyed[("en_y en_z", "c")] == 2
    with pytest.raises(IncompatibleValue):
        merge(a, a, word_keys=["en"])


def test_vocabularies_and_filters(spark, corpus):
    n = K.count_words(corpus)
    assert [r.word for r in K.create_vocabulary(n, filters=[K.truncate(4)]).orderBy("idx").collect()] == ["better", "is", "than", "complex"]
    assert {r.word for r in K.remove_least_frequent(2)(n).collect()} == {"better", "is", "than", "complex"}
    assert {r.word for r in K.remove_least_frequent(0.1)(n).collect()} == {"better", "is", "than"}
    assert "is" not in {r.word for r in K.remove_most_frequent(0.1)(n).collect()}
    assert {r.word for r in K.remove_elements("better")(n).collect()}.isdisjoint({"better"})
    assert "is" not in {r.word for r in K.remove_elements(["is"])(n).collect()}
    with pytest.raises(NotAllowedValue):
        K.remove_least_frequent(-1)
    v = vocab(spark, ["a", "b c"])
    assert K.index_of(v, "b c") == 1 and K.bigrams_of(v).count() == 1
    with pytest.raises(OutOfVocabulary):
        K.index_of(v, "z")
    both = K.merge_vocabularies(v, vocab(spark, ["z", "a"]))
    assert [r.word for r in both.orderBy("idx").collect()] == ["a", "b c", "z"]
    ids = K.encode(S.from_iterable(spark, ["a q a", ""]), v).orderBy("sent_id").collect()
    assert [r.ids for r in ids] == [[0, -1, 0], []]


def test_subsampling(spark, corpus):
    p = {r.word: r.p for r in K.subsampling(K.count_words(corpus), 0.1).collect()}
    assert p == {w: pytest.approx(1 - math.sqrt(0.1 / (6 / 30))) for w in COLUMNS}
    kept = K.subsample(corpus, K.subsampling(K.count_words(corpus), 1e-9), seed=1).collect()
    assert all(len(r.tokens) == 5 for r in kept) and sum(t is not None for r in kept for t in r.tokens) < 5
    assert K.count_bigrams(corpus).where("first = 'is' and second = 'better'").first().n == 6


def cells(spark, rows=((1, 2, 4, 0), (3, 1, 1, 0)), zero=False):
    data = [(f"w{i}", f"c{j}", x) for i, r in enumerate(rows) for j, x in enumerate(r) if x or zero]
    return spark.createDataFrame(data, "word string, ctx string, n long")


def values(df):
    return {(int(r.word[1:]), int(r.ctx[1:])): r.value for r in df.collect()}


def test_weightings(spark):
    m = cells(spark)
    assert values(W.joint(m))[0, 2] == pytest.approx(4 / 12)
    assert values(W.conditional(m))[1, 0] == pytest.approx(3 / 5)
    ratio = values(W.ratio(m))
    assert [ratio[0, j] for j in range(3)] == pytest.approx([3 / 7, 8 / 7, 48 / 35]) and [ratio[1, j] for j in range(3)] == pytest.approx([9 / 5, 4 / 5, 12 / 25])
    assert values(W.pmi(m, 2))[0, 0] == pytest.approx(-0.80647586586694853)
    assert set(values(W.ppmi(m))) == {(0, 1), (0, 2), (1, 0)}
    shifted = values(W.shifted_ppmi(m, 1, 1.25))
    assert set(shifted) == {(0, 2), (1, 0)} and shifted[1, 0] == pytest.approx(math.log(9 / 5 / 1.25))
    assert values(W.tfidf(m, 4))[0, 2] == pytest.approx(4 / 7 * math.log(4 / 3))
    for bad in (lambda: W.ratio(m, 0), lambda: W.shifted_ppmi(m, 1, 0.5), lambda: W.create_representation(m, 3)):
        with pytest.raises(NotAllowedValue):
            bad()


def test_matrix_algebra(spark):
    m = W.create_representation(cells(spark))
    assert sum(x * x for (i, _), x in values(M.normalize(m)).items() if i == 0) == pytest.approx(1)
    assert values(M.normalize(m, "max", "ctx"))[0, 0] == pytest.approx(1 / 3)
    assert values(M.normalize(m, "l1"))[1, 0] == pytest.approx(0.6)
    assert values(M.each(m, F.sqrt))[0, 2] == 2
    assert values(M.add(m, m))[0, 1] == 4 and M.allclose(m, m) and not M.allclose(m, M.add(m, m)) and M.all_positive(m)
    assert {r.word: r.nnz for r in M.nnz_per_row(m).collect()} == {"w0": 3, "w1": 3}
    ctx = K.vocabulary(spark, ["c0", "c1", "c2", "c3"])
    dense = M.as_dense(m, ctx)
    assert {r.word: r.vec for r in dense.collect()} == {"w0": [1, 2, 4, 0], "w1": [3, 1, 1, 0]}
    assert {r.word: r.vec for r in M.center(dense, 0).collect()}["w0"] == [-1, 0.5, 1.5, 0]
    assert {r.word: r.vec for r in M.center(dense, 1).collect()}["w0"] == [-0.75, 0.25, 2.25, -1.75]
    assert {r.word: r.vec for r in M.center(dense, None).collect()}["w1"] == [1.5, -0.5, -0.5, -1.5]


def test_svd(spark):
    import numpy as np

    a = np.array([[1, 0, 0, 0, 2], [0, 0, 3, 0, 0], [0, 0, 0, 0, 0.001], [0, 4, 0, 0, 0]])
    data = [(f"w{i}", f"c{j}", float(x)) for i, r in enumerate(a) for j, x in enumerate(r) if x]
    m = spark.createDataFrame(data, "word string, ctx string, value double")
    got = {r.word: r.vec for r in M.pca(m, 3).collect()}
    w = np.array([got[f"w{i}"] for i in range(4)])
    u, s, _ = np.linalg.svd(a)
    assert np.allclose(w @ w.T, u[:, :3] * s[:3] ** 2 @ u[:, :3].T, atol=1e-6)
    with pytest.raises(IncompatibleValue):
        M.svd(m, 9)


def test_a_vocabulary_is_counted_once(spark, tmp_path, monkeypatch):
    from lexigrid.plans import corpus_queries, more_queries

    calls, count = [], corpus_queries.top_words
    for m in (corpus_queries, more_queries):
        monkeypatch.setattr(m, "top_words", lambda *a: calls.append(1) or count(*a))
    assert more_queries.sparse_text_round_trip(spark, "/root/testdata/sf0.001").columns == ["word", "j", "value"] and len(calls) == 1
