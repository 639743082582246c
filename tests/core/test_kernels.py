"""Kernels over whole batches, against plain Python, and the ways that vocabularies of any size take."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrid.functions import flat
from lexigrid.functions import text as T
from lexigrid.operators import context as X
from lexigrid.operators import counts as K
from lexigrid.operators.cooccurrence import count_cooccurrence
from lexigrid.sources import persist as P

WORDS = "abcdefgh"


def made(seed, n=40):
    r = random.Random(seed)
    return [[r.choice(WORDS) for _ in range(r.choice([0, 1, 2, 7, 15]))] for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i // 4, i % 4, s) for i, s in enumerate(made(3))] + [(99, 0, ["a", None, "b", None, "a"]), (3, 0, ["a", "b"])]
    return spark.createDataFrame(rows, "doc_id int, sent_id int, tokens array<string>").cache()


def brute(sentences, window, words, vocab, draw=None):
    """Counts by walking over every place."""
    out = Counter()
    for key, s in sentences:
        b, a = window.sides
        n = window.n_grams
        inside = [t is not None and (vocab is None or t in vocab) for t in s]
        items = [i for i, ok in enumerate(inside) if ok] if window.dirty and vocab is not None else list(range(len(s)))
        for p, w in enumerate(s):
            if w is None or (words is not None and w not in words):
                continue
            near, far = draw(key, p) if draw else (b, a)
            left, right = ([i for i in items if i < p] if near else [])[-near or len(s) :], [i for i in items if i > p][:far]
            if not (window.dirty and vocab is not None):
                left, right = [i for i in items if p - near <= i < p], [i for i in items if p < i <= p + far]
            for side, is_left in ((left, True), (right, False)):
                for k in range(len(side) - n + 1):
                    run = side[k : k + n]
                    if all(inside[i] for i in run):
                        dist = run[-1] - p if is_left else run[0] - p
                        out[(w, " ".join(s[i] for i in run), *((dist,) if window.distance else ()))] += 1
    return out


WINDOWS = [X.Window(2), X.Window((1, 3), distance=True), X.Window(2, dirty=True), X.Window(3, n_grams=2), X.Window((3, 2), dirty=True, n_grams=2, distance=True), X.Window(0), X.Window(3, dynamic=True, seed=5)]


@pytest.mark.parametrize("window", WINDOWS, ids=str)
@pytest.mark.parametrize("large", [False, True])
def test_windows_against_brute_force(spark, corpus, monkeypatch, window, large):
    """``large``: as if the vocabularies were too large to be sent to the workers."""
    if large:
        monkeypatch.setattr(X, "listed", lambda *a, **k: None)
    sentences = [((r.doc_id, r.sent_id), r.tokens) for r in corpus.collect()]
    words, vocab = set("abcde"), set("bcdfh")
    frame = lambda v: K.vocabulary(spark, sorted(v))
    bases = {(r.doc_id, r.sent_id): r.b for r in corpus.select("doc_id", "sent_id", T.draw_base("doc_id", "sent_id", F.lit(window.seed), F.lit(0)).alias("b")).collect()}
    draw = (lambda key, p: (1 + int(flat.draws(np.array([bases[key]]), np.array([p]))[0]) % 3,) * 2) if window.dynamic else None
    got = count_cooccurrence(corpus, frame(words), window, frame(vocab)).collect()
    item = lambda r: (r.word, r.ctx, r.dist) if window.distance else (r.word, r.ctx)
    assert {item(r): r.n for r in got} == dict(brute(sentences, window, words, vocab, draw))
    rows = window(corpus, frame(words), frame(vocab)).collect()
    assert Counter(map(item, rows)) == brute(sentences, window, words, vocab, draw)
    assert all(r.pos >= 0 for r in rows)


def test_draws_as_columns_and_kernels(spark):
    rows = spark.range(200).select("id", T.draw_base("id", F.lit(3)).alias("b")).withColumn("x", T.draw(F.col("b"), F.col("id") % 50)).collect()
    got = flat.draws(np.array([r.b for r in rows]), np.array([r.id % 50 for r in rows]))
    assert got.tolist() == [r.x for r in rows] and 0.4 < np.mean(got) / flat.PRIME < 0.6


def test_merging_encoding_and_subsampling_with_vocabularies_of_any_size(spark, corpus, monkeypatch):
    pairs = spark.createDataFrame([("a b",), ("b a",), ("c c",)], "word string")
    vocab = K.vocabulary(spark, list("abc"))
    odds = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "word string, p double")
    told = lambda df, c: sorted((r.doc_id, r.sent_id, tuple(map(str, r[c]))) for r in df.collect())
    plain = corpus.where("doc_id <> 3 or size(tokens) > 2")
    run = lambda: (told(K.merge_bigrams(plain, pairs), "tokens"), told(K.encode(plain, vocab), "ids"), told(K.subsample(plain, odds, 2), "tokens"))
    small = run()
    monkeypatch.setattr(K, "listed", lambda *a, **k: None)
    large = run()
    assert small[0] == large[0] and small[1] == large[1] and small[2] == large[2]
    for (_, _, new), r in zip(small[0], sorted(plain.collect(), key=lambda r: (r.doc_id, r.sent_id))):
        want, i, t = [], 0, r.tokens
        while i < len(t):
            hit = i + 1 < len(t) and t[i] and t[i + 1] and f"{t[i]} {t[i + 1]}" in ("a b", "b a", "c c")
            want.append(f"{t[i]} {t[i + 1]}" if hit else str(t[i]))
            i += 2 if hit else 1
        assert list(new) == want


def test_sentence_pairs_in_chunks():
    target, o = np.array([0, 1, 0, 2, 1, 1]), np.array([0, 4, 6])
    whole = dict(zip(*next(iter(flat.sentence_pairs(target, target, o, 3)))))
    parts = Counter()
    for keys, n in flat.sentence_pairs(target, target, o, 3, limit=1):
        for k, x in zip(keys.tolist(), n.tolist()):
            parts[k] += x
    assert whole == dict(parts) == {0 * 3 + 0: 2, 1: 2, 2: 2, 3: 2, 5: 1, 6: 2, 7: 1, 4: 2}


def test_slices_hold_whole_rows():
    b = pa.RecordBatch.from_arrays([pa.array([["a"] * 5, [], ["b"] * 50, ["c"], ["d"]])], ["w"])
    assert [x.num_rows for x in flat.slices([b], "w", 10)] == [2, 1, 2]


OLD = re.compile(r"\d+((,\d*)*(\.\d*)*)*")


def test_numbers_of_any_length(spark):
    r = random.Random(1)
    lines = ["".join(r.choices("0123.,, ax", k=r.randint(0, 25))) for _ in range(3000)] + ["٣,٤.x", "1,,2..3.,4", ",.1", ""]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, s string").select("i", T.digits(F.col("s")).alias("d")).collect()
    assert {x.i: x.d for x in got} == {i: OLD.sub("0", s) for i, s in enumerate(lines)}
    assert spark.range(1).select(T.digits(F.repeat(F.lit("1,"), 200_000)).alias("d")).first().d == "0"


@pytest.mark.parametrize("lines, want", [(["2 1", "2019\t3", "x\t1"], {"2019", "x"}), (["2019\t3", "7\t4"], {"2019", "7"}), (["1 2", "x\t1\t2"], {"x"}), (["5\t1\t2", "x\t1\t2"], {"5", "x"})])
def test_heads_of_vector_files(spark, tmp_path, lines, want):
    (tmp_path / "v.txt").write_text("\n".join(lines) + "\n")
    assert {r.word for r in P.load_vectors_text(spark, str(tmp_path)).collect()} == want


def test_ranks_over_ranges(spark):
    counts = spark.createDataFrame([(f"w{i:04}", (i * 37) % 50) for i in range(2000)], "word string, n int")
    want = sorted(counts.collect(), key=lambda r: (-r.n, r.word))
    got = K.create_vocabulary(counts.repartition(6))
    assert [r.word for r in got.orderBy("idx").collect()] == [r.word for r in want] and [r.idx for r in got.orderBy("idx").collect()] == list(range(2000))
    assert K.create_vocabulary(counts.limit(0)).count() == 0
