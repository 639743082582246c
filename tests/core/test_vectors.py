import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.functions import distance as D
from lexigrid.functions.errors import NotAllowedValue, OutOfVocabulary, ResourceNotFound
from lexigrid.operators import composition as P
from lexigrid.operators import evaluation as E
from lexigrid.operators import transport as T
from lexigrid.operators import vectors as V
from lexigrid.plans import vector_queries as Q

PLACES = {"paris": (1, 0), "france": (1, 0.2), "london": (0, 1), "england": (0, 1.2), "belgium": (0.7, 0.7), "germany": (0.7, 0.8)}


def indexed(spark, named):
    return spark.createDataFrame([(w, [float(x) for x in v], i) for i, (w, v) in enumerate(named.items())], "word string, vec array<double>, idx long")


@pytest.mark.parametrize("metric", D.METRICS)
def test_columns_and_kernels_agree(spark, metric):
    r = np.random.default_rng(1)
    data = np.round(r.standard_normal((8, 6)), 1) * (r.random((8, 6)) < 0.7)
    options = {"minkowski": {"p": 3.0}, "seuclidean": {"variance": [1, 2, 3, 4, 5, 6.0]}, "mahalanobis": {"inverse": np.diag([1, 2, 3, 1, 2, 3.0])}}.get(metric, {})
    want = D.kernel(metric, **options)(data, data)
    df = spark.createDataFrame([(i, j, data[i].tolist(), data[j].tolist()) for i in range(8) for j in range(8)], "i int, j int, u array<double>, v array<double>").coalesce(1)
    got = np.zeros((8, 8))
    for row in df.select("i", "j", D.column(metric, **options)(F.col("u"), F.col("v")).alias("d")).collect():
        got[row.i, row.j] = row.d
    assert np.allclose(got, want, atol=1e-7)


def test_unknown_metric():
    for f in (D.column, D.kernel):
        with pytest.raises(NotAllowedValue):
            f("nothing")


def test_closest_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(V.grid, "__defaults__", (7,))
    r = np.random.default_rng(2)
    data = r.integers(-2, 3, (40, 3)).astype(float)  # many ties
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "word long, vec array<double>")
    got = {}
    for row in V.closest(v, v, 5, "cityblock").collect():
        got.setdefault(row["query"], []).append((row["rank"], row.word))
    for i in range(40):
        d = np.abs(data - data[i]).sum(axis=1)
        want = [j for j in sorted(range(40), key=lambda j: (d[j], j)) if j != i][:5]
        assert [w for _, w in sorted(got[i])] == want


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cosine"])
def test_nearest_equal_and_near_rows(spark, monkeypatch, metric):
    """Copies, and rows that differ in late digits only, come in the order of all distances sorted."""
    monkeypatch.setattr(V.grid, "__defaults__", (40,))
    r = np.random.default_rng(8)
    data = np.repeat(r.standard_normal((12, 5)) * 100, 8, axis=0)
    data[::3] += r.standard_normal((32, 5)) * 1e-7
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "word long, vec array<double>")
    got = {(x["query"], x["rank"]): (x.word, x.distance) for x in V.closest(v.where("word % 10 = 0"), v, 9, metric).collect()}
    d = np.array(D.kernel(metric)(data, data))
    for i in range(0, 96, 10):
        want = [j for j in sorted(range(96), key=lambda j: (round(d[i, j], 12), j)) if j != i][:9]
        if metric != "cosine":  # a product's last digit depends on the strip
            assert [got[i, k + 1][0] for k in range(9)] == want
        assert [got[i, k + 1][1] for k in range(9)] == pytest.approx(d[i, want].tolist(), abs=1e-9)
    assert len(got) == 90


def test_pair_totals(spark, monkeypatch):
    monkeypatch.setattr(V.grid, "__defaults__", (7,))
    data = np.random.default_rng(9).integers(-3, 4, (30, 4)) / 4
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "word long, vec array<double>")
    for metric in ("cityblock", "chebyshev"):
        got = {x.a: (x.total, x.n) for x in V.pair_totals(v.where("word < 5"), v, metric).collect()}
        assert got == {i: (pytest.approx(D.kernel(metric)(data[i : i + 1], data).sum()), 30) for i in range(5)}


def test_pairs_and_errors(spark):
    v = V.vectors_of(spark, {"a": (0, 1), "b": (1, 0), "c": (1, 1)})
    assert V.distance(v, "a", "b") == pytest.approx(1) and V.distance(v, "a", "c", "euclidean") == pytest.approx(1)
    with pytest.raises(OutOfVocabulary):
        V.distance(v, "a", "z")
    got = {(r.a, r.b): r.distance for r in V.pairwise(v, v, lambda x, y: x @ y.T).collect()}
    assert len(got) == 9 and got["c", "c"] == 2
    pairs = spark.createDataFrame([("a", "b"), ("a", "z")], "a string, b string")
    assert {r.b: r.distance for r in V.distances(pairs, v, "sqeuclidean").collect()} == {"b": 2.0, "z": None}


def test_column_statistics(spark):
    data = np.random.default_rng(3).standard_normal((50, 4))
    variance, inverse = V.column_statistics(V.vectors_of(spark, data).repartition(3))
    assert np.allclose(variance, data.var(axis=0, ddof=1)) and np.allclose(inverse, np.linalg.inv(np.cov(data.T)))


def test_histograms(spark):
    v = V.vectors_of(spark, {"a": (1, 0), "b": (1, 1), "c": (0, 1), "d": (1, 0.5)})
    edges = [0, math.pi / 4 + 1e-9, math.pi / 2, math.pi]
    f = lambda df: [r.n for r in df.orderBy("bin").collect()]
    assert f(V.word_histogram(v, "a", edges)) == [2, 0, 1] or f(V.word_histogram(v, "a", edges)) == [2, 1, 0]
    assert sum(f(V.pair_histogram(v, edges))) == 6
    values = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 2.5, -1.0)], "distance double")
    assert f(V.histogram(values, [0, 1, 2])) == np.histogram([0, 1, 1.5, 2, 2.5, -1], [0, 1, 2])[0].tolist()


def test_isotropy(spark):
    data = np.random.default_rng(4).standard_normal((30, 5))
    v, c = V.vectors_of(spark, data).repartition(3), V.vectors_of(spark, data[:4])
    z = np.exp(data[:4] @ data.T).sum(axis=1)
    got = V.isotropy(v, c, 0.2).first()
    assert got.mean == pytest.approx(z.mean()) and got.share == ((z > 0.8 * z.mean()) & (z < 1.2 * z.mean())).mean()
    norms = [np.linalg.norm(r.vec) for r in V.random_directions(v, 10).collect()]
    assert norms == pytest.approx([math.sqrt(5) / 5 / np.linalg.norm(data, axis=1).mean()] * 10)


def test_analogy_queries_search_ids_past_300000(spark, tmp_path):
    data = np.random.default_rng(6).standard_normal((8, 5)).round(2).tolist()
    ids = range(299_997, 300_005)
    spark.createDataFrame([(i, v, 0) for i, v in zip(ids, data)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for query in (Q.analogy_cosadd, Q.analogy_cosmul):
        got = {(r.a, r.word) for r in query(spark, str(tmp_path)).collect()}
        assert len(got) == 3 and {a for a, _ in got} == {"w300000"} and any(w > "w300000" for _, w in got)


def test_analogies(spark):
    v = indexed(spark, PLACES)
    q = spark.createDataFrame([("paris", "france", "london"), ("paris", "france", "nowhere")], "a string, b string, c string")
    got = [(r.method, r.word) for r in E.predict_analogies(q, v).collect()]
    assert sorted(got) == [("cosadd", "england"), ("cosmul", "england")]
    data = {"one": ["paris france london england", "paris france london england"], "two": {"x": ["paris france london germany", ": title"], "y": ["a b c d", "PARIS france london england"]}}
    asked = E.analogies(E.dataset(spark, data, "all"))
    scores = {r.path: (r.cosadd, r.nb) for r in E.evaluate_analogies(asked, v).collect()}
    assert scores == {"all": (0.75, 4), "all/one": (1.0, 2), "all/two": (0.5, 2), "all/two/x": (0.0, 1), "all/two/y": (1.0, 1)}
    stats = {r.path: tuple(r)[1:] for r in E.statistics(E.known(asked, v)).collect()}
    assert stats["all"] == (5, 1, 4, 2) and stats["all/one"] == (2, 0, 2, 1) and stats["all/two"] == (3, 1, 2, 0)
    once = {r.path: (r.cosadd, r.nb) for r in E.evaluate_analogies(asked, v, keep_duplicates=False).collect()}
    assert once["all"] == (0.5, 2)
    text = E.report("analogy", E.evaluate_analogies(asked, v), E.statistics(E.known(asked, v)), show_subsets=True)
    assert "(including 2 duplicates)" in text and "75.00%" in text and all(len(x) <= 96 for x in text.splitlines())


def test_outliers(spark):
    v = V.vectors_of(spark, {"a": (1, 0.2), "b": (0.9, 0.1), "c": (1.1, 0.1), "d": (0.3, 0.9), "e": (0.2, 1), "f": (0.1, 0.9)})
    asked = E.outliers(E.dataset(spark, ["a b c d", "d e f a", "a b e c", "d e c f", "a b c d e", "a q"], "o"))
    got = {r.key: r.position for r in E.outlier_positions(asked.where("key <> 'a q'"), v).collect()}
    assert got == {"a b c d": 4, "d e f a": 4, "a b e c": 3, "d e c f": 3, "a b c d e": 5}
    score = E.evaluate_outliers(asked, v).first()
    assert (score.nb, score.accuracy) == (5, 0.6) and score.opp == pytest.approx((1 + 1 + 0.75 + 0.75 + 1) / 5)


def test_similarity(spark):
    v = V.vectors_of(spark, {w: (math.cos(i), math.sin(i)) for i, w in enumerate("abcdef")})
    asked = E.similarities(E.dataset(spark, ["a b 9", "a,c,4", "a d 1", "b c 8", "A B 9", "a z 1"], "s"))
    got = E.evaluate_similarities(asked, v).first()
    x, y = [math.cos(1), math.cos(2), math.cos(3), math.cos(1), math.cos(1)], [9, 4, 1, 8, 9]
    assert got.nb == 5 and got.pearson == pytest.approx(np.corrcoef(x, y)[0, 1]) and got.spearman > 0.9
    none = E.evaluate_similarities(E.similarities(E.dataset(spark, ["q z 1"], "s")), v).first()
    assert none.nb == 0 and none.pearson is None
    assert E.p_value(0.5, 10) == pytest.approx(0.14111, abs=1e-4) and E.p_value(0.9, 5) == pytest.approx(0.03739, abs=1e-4)
    assert math.isnan(E.p_value(None, 0)) and E.p_value(1.0, 5) == 0.0 and E.p_value(0.3, 2) == 1.0


def test_datasets_from_files(spark, tmp_path):
    import zipfile

    (tmp_path / "set" / "sub").mkdir(parents=True)
    (tmp_path / "set" / "one.txt").write_text("a b c d\n\ne f g h\n")
    (tmp_path / "set" / "sub" / "two.txt").write_text("i j k l\n")
    want = [("set/one", "a b c d"), ("set/one", "e f g h"), ("set/sub/two", "i j k l")]
    assert sorted((r.path, r.line) for r in E.dataset(spark, tmp_path / "set").collect()) == want
    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        z.write(tmp_path / "set" / "one.txt", "one.txt")
        z.write(tmp_path / "set" / "sub" / "two.txt", "sub/two.txt")
    assert sorted((r.path, r.line) for r in E.dataset(spark, tmp_path / "set.zip").collect()) == want
    with pytest.raises(ResourceNotFound):
        E.dataset(spark, tmp_path / "none")


def brute_transport(a, b, cost):
    """All ways to match units."""
    import itertools

    left = [i for i, n in enumerate(a) for _ in range(n)]
    right = [j for j, n in enumerate(b) for _ in range(n)]
    return min(sum(cost[i, j] for i, j in zip(left, p)) for p in set(itertools.permutations(right)))


@pytest.mark.parametrize("seed", range(12))
def test_transport_is_exact(seed):
    r = np.random.default_rng(seed)
    n, m = r.integers(1, 5, 2)
    a, b = r.multinomial(6, np.ones(n) / n), r.multinomial(6, np.ones(m) / m)
    cost = r.random((n, m)).round(2)
    got, flow = T.transport(a.tolist(), b.tolist(), cost)
    assert got == pytest.approx(brute_transport(a, b, cost)) and (flow.sum(axis=1) == a).all() and (flow.sum(axis=0) == b).all() and (flow >= 0).all()


def test_word_mover_distance(spark):
    v = V.vectors_of(spark, {"obama": (1, 0, 0, 0), "speaks": (0, 1, 0, 0), "media": (0, 0, 1, 0), "illinois": (0, 0, 0, 1), "president": (1.45, 0, 0, 0), "greets": (0, 1.24, 0, 0), "press": (0, 0, 1.2, 0), "chicago": (0, 0, 0, 1.18), "the": (9, 9, 9, 9)})
    s = spark.createDataFrame([(0, "obama speaks to the media in illinois".split()), (1, "the president greets the press in chicago".split()), (2, ["unknown"])], "id int, tokens array<string>")
    pairs = spark.createDataFrame([(0, 1), (1, 0), (0, 2)], "a int, b int")
    got = {(r.a, r.b): (r.distance, {(x.source, x.target, x.share) for x in r.flow}) for r in T.word_mover_distance(pairs, s, v, ["to", "the", "in"]).collect()}
    assert got[0, 1][0] == pytest.approx(1.07 / 4) == got[1, 0][0]
    assert got[0, 1][1] == {("obama", "president", 0.25), ("speaks", "greets", 0.25), ("media", "press", 0.25), ("illinois", "chicago", 0.25)}
    assert math.isnan(got[0, 2][0])


def test_composition(spark):
    r = np.random.default_rng(5)
    words = {w: r.random(4) for w in "abcdefgh"}
    bigrams = [(x, y) for x in "abcd" for y in "efgh"]
    u, v = (np.array([words[b[k]] for b in bigrams]) for k in (0, 1))

    def made(p):
        rows = P.bigram_rows(V.vectors_of(spark, words | {f"{x} {y}": z for (x, y), z in zip(bigrams, p)}))
        assert rows.count() == 16
        return rows

    got = P.Additive.fit(made(0.4 * u + 0.6 * v))
    assert (got.alpha, got.beta) == (pytest.approx(0.4), pytest.approx(0.6))
    uv, uu = (u * v).sum(axis=1, keepdims=True), (u * u).sum(axis=1, keepdims=True)
    assert P.Dilation.fit(made(0.69 * uv * u + uu * v)).factor == pytest.approx(1.69)
    a, b = r.random((4, 4)), r.random((4, 4))
    p = u @ a.T + v @ b.T
    rows = made(p)
    full = P.FullAdditive.fit(rows)
    back = {(x.first, x.second): x.vec for x in full.predict(rows).collect()}
    assert np.allclose([back[k] for k in bigrams], p, atol=1e-2)
    lexical = P.Lexical.fit(rows, "a", 3)
    near = {x.second: x.vec for x in lexical.predict(rows.where(F.col("first") == "a")).collect()}
    assert np.allclose([near[y] for y in "efgh"], p[:4], atol=1e-2)
    pairs = spark.createDataFrame([("a", "e"), ("a", "nothing")], "first string, second string")
    assert P.compose(pairs, V.vectors_of(spark, words), P.Multiplicative()).first().vec == pytest.approx((words["a"] * words["e"]).tolist())
