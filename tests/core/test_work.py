"""What queries do not do: rows that would grow faster than the table, or that need not leave their task."""

import pytest

from lexigrid.functions import flat
from lexigrid.operators import contextual as B
from lexigrid.operators import counts as K
from lexigrid.plans import catalog
from tests import comparing

TEXTS = [(7, "a b c d e f g h i j\nk l m\n\n" + "w " * 90), (-3, "x y z x y z x"), (None, "one two three four five"), (0, "one"), (12, None), (100000, "p q r s t"), (8, "A a\tB  b É é a b a b a\na\n")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts with null and negative ids, tabs, blank lines and no text."""
    return written(spark, str(tmp_path_factory.mktemp("odd")), TEXTS)


@pytest.fixture(scope="module")
def keyed(spark, tmp_path_factory):
    """Those with an id: SQL's joins of tokens with tokens have no others."""
    return written(spark, str(tmp_path_factory.mktemp("keyed")), [x for x in TEXTS if x[0] is not None])


def written(spark, where, texts):
    spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string").write.parquet(f"{where}/documents.parquet")
    import glob
    import os

    # DuckDB reads one file.
    one = spark.read.parquet(f"{where}/documents.parquet").coalesce(1)
    one.write.parquet(f"{where}/one")
    os.mkdir(f"{where}/in")
    os.rename(glob.glob(f"{where}/one/*.parquet")[0], f"{where}/in/documents.parquet")
    return f"{where}/in"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_are_ranked_in_their_tasks(spark, odd, monkeypatch):
    for name in ("best_spans", "antecedent_buckets"):
        made = catalog.QUERIES[name](spark, odd)
        assert "Window" not in plan(made) and "SortMergeJoin" not in plan(made) and "Broadcast" not in plan(made)
        assert comparing.differences(made, catalog.ORACLE[name], odd) == []


def test_spans_of_several_sentences_of_a_document(spark, monkeypatch):
    sizes = spark.createDataFrame([(1, 6), (1, 11), (2, 3), (3, 2), (4, 40), (4, 0)], "doc_id long, n int")
    score = lambda doc, start, end: (start * 5 + end * 3 + doc) % 4
    spans = [(d, k, n, s, e) for k, (d, n) in enumerate((r.doc_id, r.n) for r in sizes.collect()) for s in range(n) for e in range(s, min(s + 4, n))]
    want: dict = {}
    for d in {x[0] for x in spans}:
        best = sorted((x for x in spans if x[0] == d), key=lambda x: (-score(d, x[3], x[4]), x[3], x[4], x[1]))
        if kept := [(x[3], x[4]) for i, x in enumerate(best) if i < int(0.4 * x[2])]:
            want[d] = kept
    got = {r.doc_id: list(zip(r.starts, r.ends)) for r in B.best_spans_by_place(sizes, 4, score).collect()}
    assert {d: [x[0] for x in v] for d, v in got.items()} == {d: [x[0] for x in v] for d, v in want.items()} and got.keys() == want.keys() == {1, 2, 4}


def test_antecedents_are_counted_without_pairs(spark):
    spans = spark.createDataFrame([(d, i, i) for d, n in ((1, 1), (2, 2), (3, 70), (4, 51)) for i in range(n)], "doc_id long, start int, end int")
    pairs = {r.bucket: r["count"] for r in B.antecedents(spans).groupBy("bucket").count().collect()}
    got = B.antecedent_buckets(spans.groupBy("doc_id").count().withColumnRenamed("count", "n"))
    assert {r.bucket: r.n for r in got.collect()} == pairs


def test_annotated_tokens_are_counted_in_their_tasks(spark, keyed):
    """Tokens aren't exploded: a row that leaves a task is a distinct word or pair of a batch."""
    for name in ("annotated_bigrams", "annotated_vocabulary", "annotated_lemma_counts", "bigram_counts"):
        made = catalog.QUERIES[name](spark, keyed)
        assert "Generate explode(arrays_zip" not in plan(made) and "Generate explode(transform" not in plan(made)
        assert comparing.differences(made, catalog.ORACLE[name], keyed) == []
    few = spark.range(0, 4000, 1, 4).selectExpr("id as doc_id", "0 as sent_id", "array('a', null, 'b', 'a', null) as tokens")
    got = K.count_bigrams(few)
    assert {(r.first, r.second): r.n for r in got.collect()} == {("a", None): 8000, (None, "b"): 4000, ("b", "a"): 4000}
    assert "MapInArrow" in plan(got)


def test_held_counts():
    import numpy as np
    import pyarrow as pa

    held, rows = flat.Held(["a", "b"], limit=10), []
    for i in range(40):
        rows += [r for b in held.add([pa.array(["x", None, f"y{i}"]), pa.array([1, 2, i])], np.array([1, 2, 3])) for r in b.to_pylist()]
        assert held.rows <= 10
    rows += [r for b in held.rest() for r in b.to_pylist()]
    total: dict = {}
    for r in rows:
        total[r["a"], r["b"]] = total.get((r["a"], r["b"]), 0) + r["n"]
    assert total == {("x", 1): 40, (None, 2): 80} | {(f"y{i}", i): 3 for i in range(40)} and len(rows) < 120


def test_sentence_pairs_as_a_matrix(monkeypatch):
    """Cells of short and long sentences are those of the pairs."""
    import numpy as np

    r = np.random.default_rng(3)
    o = np.concatenate([[0], np.cumsum(r.integers(0, 60, 700))])
    target, ctx = r.integers(-1, 40, o[-1]), r.integers(-1, 40, o[-1])
    both = np.where(r.random(o[-1]) < 0.7, target, -1)
    for x, y in ((target, target), (target, both), (both, target), (target, ctx)):
        want = np.zeros(1600, np.int64)
        for keys, n in flat.sentence_pairs(x, y, o, 40):
            want[keys] += n
        for long in (1, 12, 1000):
            monkeypatch.setattr(flat, "LONG", long)
            got = np.zeros(1600, np.int64)
            assert list(flat.sentence_pairs(x, y, o, 40, limit=500, total=got)) == [] and (got == want).all()


def test_cells_of_vocabularies_leave_a_task_once(spark):
    """One row a cell and task, however many batches a task has."""
    from lexigrid.operators import context as X
    from lexigrid.operators.cooccurrence import count_cooccurrence

    few = spark.range(0, 30000, 1, 2).selectExpr("id as doc_id", "0 as sent_id", "array('a', 'b', 'a', if(id % 3 = 0, 'c', 'a')) as tokens")
    v = K.vocabulary(spark, ["a", "b", "c"])
    for context in (X.Window(2), X.Sentence(), X.Window((1, 2), dirty=True)):
        made = count_cooccurrence(few, v, context, v)
        found = made._jdf.queryExecution().optimizedPlan().children().apply(0)
        rows = made._jdf.sparkSession().sessionState().executePlan(found, made._jdf.queryExecution().mode()).toRdd().count()
        assert rows <= 2 * 9, rows
        rows = context(few, v, v).groupBy("word", "ctx").count().collect()
        assert {(r.word, r.ctx): r.n for r in made.collect()} == {(r.word, r.ctx): r["count"] for r in rows}


def test_angles_by_bins(spark, monkeypatch):
    """All pairs once, at edges as elsewhere; two blocks meet in one task."""
    import math

    import numpy as np

    from lexigrid.functions import distance as D
    from lexigrid.operators import vectors as V

    edges = [math.pi * i / 40 for i in range(41)]
    r = np.random.default_rng(1)
    m = r.standard_normal((500, 5))
    m[:8] = [[math.cos(math.pi * i / 40), math.sin(math.pi * i / 40), 0, 0, 0] for i in (0, 1, 10, 20, 30, 39, 40, 0)]
    m[8], m[9] = 0, m[10]
    m[20:260] = np.round(m[20:260])
    for cuts in (np.array(edges), np.array([0.3, 0.30001, 1.0, 3.0])):
        for chosen in (None, r.random((500, 500)) < 0.5):
            d = D.kernel("angle")(m, m)
            assert (V._angle_counts(m, m, cuts, chosen) == np.histogram(d if chosen is None else d[chosen], cuts)[0]).all()
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "word long, vec array<double>")
    want = np.histogram(D.kernel("angle")(m, m)[np.triu_indices(500, 1)], edges)[0].tolist()
    met = []
    grid = V.grid
    monkeypatch.setattr(V, "grid", lambda *a: met.append(grid(*a)) or met[-1])
    assert [x.n for x in V.pair_histogram(v, edges, block=64).orderBy("bin").collect()] == want and sum(want) == 500 * 499 // 2
    # one strip a pair of 8 blocks, with 41 - 1 bins each
    assert met[0].count() == 40 * 8 * 9 // 2


def test_discovered_contexts_are_added_up_as_they_come_by():
    """Sorted rows of contexts, cut into batches and limits anywhere, give the counts of the pairs."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    names, named = pa.array(["t0", "t1", "t2"]), pa.array([f"c{i}" for i in range(9)])
    want: dict = {}
    made = []
    for _ in range(40):
        ctx, word = r.integers(0, 9, 30) ** 2 // 9, r.integers(0, 3, 30)
        for c, w in zip(ctx.tolist(), word.tolist()):
            want[f"t{w}", f"c{c}"] = want.get((f"t{w}", f"c{c}"), 0) + 1
        made.append(flat.nested([ctx * 3 + word], 3, named))
        assert made[-1].num_rows == len(set(ctx.tolist()))
    met = pa.Table.from_batches(made).sort_by("ctx").combine_chunks().to_batches()[0]
    for size in (1, 7, 1000):
        batches = [met.slice(i, size) for i in range(0, met.num_rows, size)]
        for limit in (1, 10, 10**6):
            got = [x for b in flat.unnested(iter([met.slice(0, 0), *batches]), names, limit) for x in b.to_pylist()]
            assert len(got) == len(want) and {(x["word"], x["ctx"]): x["n"] for x in got} == want
    assert list(flat.unnested(iter([]), names)) == []


def test_discovered_contexts_leave_a_task_once(spark, keyed):
    """What is shuffled is a row for each context of a task, not for each pair."""
    from lexigrid.operators import context as X
    from lexigrid.operators.cooccurrence import count_cooccurrence

    few = spark.range(0, 30000, 1, 2).selectExpr("id as doc_id", "0 as sent_id", "array('a', 'b', null, 'a', if(id % 3 = 0, 'c', 'a'), 'b', 'd')  as tokens")
    v = K.vocabulary(spark, ["a", "b", "c"])
    for context in (X.Window(2), X.Window((1, 3)), X.Window(2, dirty=True), X.Window(3, n_grams=2), X.Window(3, dynamic=True, seed=2)):
        made = count_cooccurrence(few, v, context)
        node = made._jdf.queryExecution().optimizedPlan()
        while "Repartition" not in node.nodeName() and "Aggregate" not in node.nodeName():
            node = node.children().apply(0)
        found = made._jdf.sparkSession().sessionState().executePlan(node.children().apply(0), made._jdf.queryExecution().mode()).toRdd().count()
        rows = context(few, v).groupBy("word", "ctx").count().collect()
        assert found <= 2 * len({r.ctx for r in rows}), found
        assert {(r.word, r.ctx): r.n for r in made.collect()} == {(r.word, r.ctx): r["count"] for r in rows}
    made = catalog.QUERIES["cooc_asymmetric_discovered"](spark, keyed)
    assert comparing.differences(made, catalog.ORACLE["cooc_asymmetric_discovered"], keyed) == []
