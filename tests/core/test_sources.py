import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.functions.errors import NotAllowedValue, ResourceNotFound, UnsupportedType
from lexigrid.operators import context as X
from lexigrid.operators import contextual as B
from lexigrid.operators import counts as K
from lexigrid.sources import corpus as S
from lexigrid.sources import persist as P
from lexigrid.streaming import counts as C


def tokens(df):
    return [r.tokens for r in df.orderBy("doc_id", "sent_id").collect()]


def test_text_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("One two\n\nthree, 12.5\n")
    (tmp_path / "d" / ".hidden").write_text("no\n")
    with gzip.open(tmp_path / "d" / "e" / "b.txt.gz", "wt") as f:
        f.write("é zip\n")
    got = S.read_text(spark, str(tmp_path / "d"), lower=True, digit=True, ignore_punctuation=True)
    assert tokens(got) == [["one", "two"], [], ["three", "0"], ["é", "zip"]]
    assert K.describe(got).first().asDict() == {"n_sentences": 4, "n_tokens": 6, "n_words": 6}
    assert len(S.peek(got, 2).collect()) == 2


def test_iterables(spark):
    assert tokens(S.from_iterable(spark, [["A,", "b"], [","]], lower=True, ignore_punctuation=True)) == [["a", "b"], []]
    with pytest.raises(UnsupportedType):
        S.from_iterable(spark, ["a", ["b"]])
    with pytest.raises(UnsupportedType):
        S.read(spark, "x", lambda s, p: s.range(1))


def test_conll(spark, tmp_path):
    (tmp_path / "a.conll").write_text("# c\n1\tStars\tStar\tN\t_\t2\tnsubj\n2\tshine\tshine\tV\t_\t0\troot\n\n\n1-2\tdu\t_\t_\t_\t_\t_\n1\tOn\tOn\tP\t_\t0\troot")
    got = tokens(S.read_conll(spark, str(tmp_path / "a.conll"), lower=True))
    assert [[t.form for t in s] for s in got] == [["stars", "shine"], ["on"]] and got[0][0].lemma == "star"


@pytest.mark.parametrize("split", [23, 1 << 20])
def test_files_cut_anywhere(spark, tmp_path, monkeypatch, split):
    """Splits that end within sentences, lines and runs of blank lines give what whole files give."""
    r = np.random.default_rng(split)
    kinds = ["1\ta\tb\n", "2\tc\n", "1-2\tx\n", "\n", "\n", " \t\n", "# note\n", "3\tlonger words here\r\n", "\r\n"]
    texts = {f"{tmp_path}/f{i}.conll": "".join(r.choice(kinds, n)) + end for i, (n, end) in enumerate([(60, ""), (60, "9\tend"), (3, "\n\n"), (200, "# last"), (1, "1\tz")])}
    texts[f"{tmp_path}/g.conll.gz"] = "".join(r.choice(kinds, 50))
    for path, text in texts.items():
        with (gzip.open if path.endswith("gz") else open)(path, "wt", newline="") as f:
            f.write(text)
    rows = lambda df: sorted((x.doc_id.split("/")[-1], x.sent_id, tuple(map(tuple, x.tokens))) for x in df.collect())
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id string, value string")
    lines = [(p.split("/")[-1], i, len(x.split())) for p, t in texts.items() for i, x in enumerate((t[:-1] if t.endswith("\n") else t).split("\n"))]
    sizes = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": 0}
    was, write = {k: spark.conf.get(k) for k in sizes}, S.materialize

    def conf(values):
        for k, v in values.items():
            spark.conf.set(k, v)

    def cut(df, name):  # only the files themselves are read in so small splits
        conf(sizes)
        try:
            return write(df, name)
        finally:
            conf(was)

    monkeypatch.setattr(S, "materialize", cut)
    got = rows(S.read_conll(spark, str(tmp_path)))
    words = [(x.doc_id.split("/")[-1], x.sent_id, len(x.tokens)) for x in S.read_text(spark, str(tmp_path)).collect()]
    assert got == rows(S.conll_sentences(docs)) and len(got) > 40
    assert sorted(words) == sorted(lines)


def test_xml(spark, tmp_path):
    xml = """<root><document><sentences><sentence id="1"><tokens><token id="1"><word>Stars</word><lemma>star</lemma><POS>N</POS></token><token id="2"><word>shine</word></token></tokens>
    <dependencies type="basic-dependencies"><dep type="nsubj"><governor idx="2">shine</governor><dependent idx="1">Stars</dependent></dep></dependencies></sentence></sentences></document></root>"""
    want = [("1", "Stars", "star", "N", "_", "2", "nsubj"), ("2", "shine", "_", "_", "_", "_", "_")]
    assert [tuple(t) for t in tokens(S.from_xml_string(spark, xml))[0]] == want
    (tmp_path / "a.xml").write_text(xml)
    assert [tuple(t) for t in tokens(S.read_xml(spark, str(tmp_path / "a.xml")))[0]] == want


SENT = "1\taustralian\t_\tJJ\t_\t_\t2\tamod\t_\t_\n2\tscientist\t_\tNN\t_\t_\t3\tnsubj\t_\t_\n3\tdiscovers\t_\tVB\t_\t_\t0\troot\t_\t_\n4\tstar\t_\tNN\t_\t_\t3\tdobj\t_\t_\n5\twith\t_\tIN\t_\t_\t6\tcase\t_\t_\n6\ttelescope\t_\tNN\t_\t_\t3\tnmod\t_\t_\n"


def dependency(spark, **k):
    docs = spark.createDataFrame([(0, SENT)], "doc_id int, value string")
    out = {}
    for r in X.Dependency(**k)(S.conll_sentences(docs, fields=S.CONLLU)).collect():
        out.setdefault(r.word, set()).add(r.ctx)
    return out


def test_dependency_contexts(spark):
    plain = dependency(spark, labels=True)
    assert plain["scientist"] == {"australian/amod", "discovers/nsubj-"} and plain["discovers"] == {"scientist/nsubj", "star/dobj", "telescope/nmod"}
    assert dependency(spark, directed=True)["scientist"] == {"australian"} and "australian" not in dependency(spark, directed=True)
    assert dependency(spark, collapse=True, labels=True)["discovers"] == {"scientist/nsubj", "star/dobj", "telescope/case_with"}
    deep = dependency(spark, depth=2, labels=True, directed=True)
    assert deep["discovers"] == {"scientist/nsubj", "australian/nsubj_amod", "star/dobj", "telescope/nmod", "with/nmod_case"}
    assert dependency(spark, deprel_keep="amod") == {"australian": {"scientist"}, "scientist": {"australian"}}
    with pytest.raises(NotAllowedValue):
        X.Dependency(depth=0)


def test_vocabulary_files(spark, tmp_path):
    v = K.vocabulary(spark, ["b", ("new", "york"), "a"])
    P.save_vocabulary(v, f"{tmp_path}/v", language="en")
    got, params = P.load_vocabulary(spark, f"{tmp_path}/v")
    assert [tuple(r) for r in got.orderBy("idx").collect()] == [("b", 0), ("new york", 1), ("a", 2)] and params == {"language": "en"}
    t = spark.createDataFrame([(("cats", "N"), 0)], "word struct<form:string,POS:string>, idx long")
    P.save_vocabulary(t, f"{tmp_path}/t")
    assert P.load_vocabulary(spark, f"{tmp_path}/t")[0].first().word.asDict() == {"form": "cats", "POS": "N"}


def test_representation_and_vector_files(spark, tmp_path):
    m = spark.createDataFrame([("a", "x", 1.5)], "word string, ctx string, value double")
    v = K.vocabulary(spark, ["a", "b"])
    P.save_representation(f"{tmp_path}/r", m, v, K.vocabulary(spark, ["x"]), weighting="ppmi")
    kind, tables, params = P.load_representation(spark, f"{tmp_path}/r")
    assert kind == "counts" and params == {"weighting": "ppmi"} and tables["matrix"].first().value == 1.5
    with pytest.raises(ResourceNotFound):
        P.load_tables(spark, f"{tmp_path}/none")
    vec = spark.createDataFrame([("a", [1.0, -0.25]), ("new york", [0.5, 1e-9])], "word string, vec array<double>")
    for gz in (False, True):
        P.save_vectors_text(vec, f"{tmp_path}/t{gz}", gzip=gz)
        assert {r.word: r.vec for r in P.load_vectors_text(spark, f"{tmp_path}/t{gz}").collect()} == {r.word: r.vec for r in vec.collect()}
    with pytest.raises(NotAllowedValue):
        P.save_vectors_text(vec, f"{tmp_path}/bad", sep=",")
    P.save_sparse_text(m, v, K.vocabulary(spark, ["w", "x"]), f"{tmp_path}/s")
    assert [tuple(r) for r in P.load_sparse_text(spark, f"{tmp_path}/s").collect()] == [("a", 1, 1.5)]


def test_streams_count_what_batches_count(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b a\nc{i}") for i in range(6)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    seen = {}

    def sink(df, _):
        seen.update({(r.word, r.ctx): r.n for r in df.collect()})

    C.drain(C.cooccurrence(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 1), sink)
    assert seen == {("a", "b"): 12, ("b", "a"): 12}


def test_word_level_tokens_and_forms(spark):
    v = B.token_vocabulary(spark, {"this": 0, "is": 1, "\u00e9": 2})
    docs = spark.createDataFrame([(0, "This is é test")], "doc_id int, text string")
    assert [r.token_id for r in B.word_level(docs, v, lower=True, form="NFC").orderBy("pos").collect()] == [0, 1, 2, 3]
    with pytest.raises(NotAllowedValue):
        B.unicode_form(F.lit("a"), "NFX")


def test_subword_merging(spark):
    spans = [(0, 0), (0, 1), (2, 6), (7, 9), (10, 15), (16, 20), (20, 22), (22, 27), (0, 0)]
    rows = [(0, i, a, b, [float(i), 1.0]) for i, (a, b) in enumerate(spans)]
    t = spark.createDataFrame(rows, "sent_id int, pos int, start int, end int, vec array<double>")
    assert [r.word for r in B.word_index(t).orderBy("pos").collect()] == [0, 1, 2, 3, 4, 4, 4]
    merged = {r.word: r.vec for r in B.merge_subwords(t).collect()}
    assert merged[4] == [6.0, 1.0] and len(merged) == 5
    both = B.merge_subwords(t).unionByName(B.merge_subwords(t).where("word < 2").withColumn("sent_id", F.lit(1)))
    assert {r.sent_id: (len(r.vecs), r.vecs[4]) for r in B.padded(both).collect()} == {0: (5, [6.0, 1.0]), 1: (5, [0.0, 0.0])}


def test_subwords_by_tokenizer_file(spark):
    import tokenizers

    path = "/opt/tokenizers/byte_bpe_50k.json"
    docs = spark.createDataFrame([(0, "Hello big world"), (1, None), (2, "")], "doc_id int, text string")
    got = {r.doc_id: (r.ids, r.starts) for r in B.subwords(docs, path).collect()}
    e = tokenizers.Tokenizer.from_file(path).encode("Hello big world", add_special_tokens=False)
    assert got[0] == (e.ids, [o[0] for o in e.offsets]) and got[1] == (None, None) and got[2] == ([], [])


def test_chunks_and_answers(spark):
    rows = spark.createDataFrame([(0, list(range(10)), 6, 7), (1, [5], 0, 0), (2, [], 0, 0)], "doc_id int, tokens array<int>, answer_start int, answer_end int")
    got = B.chunks(rows, taken=F.lit(2), max_length=6, stride=1, keep=("doc_id", "answer_start", "answer_end"))
    assert sorted((r.doc_id, r.start, tuple(r.tokens)) for r in got.collect()) == [(0, 0, (0, 1, 2, 3)), (0, 3, (3, 4, 5, 6)), (0, 6, (6, 7, 8, 9)), (1, 0, (5,))]
    assert {(r.doc_id, r.chunk): (r.span_start, r.span_end) for r in B.answer_span(got).collect()} == {(0, 0): (-1, -1), (0, 1): (-1, -1), (0, 2): (0, 1), (1, 0): (0, 0)}
    assert B.question_context_pairs("q", ["a", "b"]) == [("q", "a"), ("q", "b")]
    with pytest.raises(UnsupportedType):
        B.question_context_pairs(["q", "r"], ["a", "b", "c"])


def test_choices_and_scores(spark):
    t = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 2.0)], "example_id int, choice int, logit double")
    r = B.best_choice(t).first()
    assert r.choice == 1 and r.score == pytest.approx(0.4223188)
    s = spark.range(1).select(B.class_scores(F.array(F.lit(1.0), F.lit(1.0))).alias("c"), B.top_tokens(F.array(*map(F.lit, [0.1, 0.7, 0.7])), 2).alias("t")).first()
    assert s.c == [0.5, 0.5] and [x.id for x in s.t] == [1, 2]


def test_coreference(spark):
    assert B.merge_mentions([(1, 0), (3, 2), (2, 1)]) == [[0, 1, 2], [2, 3]] or B.merge_mentions([(1, 0), (3, 2), (2, 1)]) == [[0, 1, 2], [2, 3]]
    links = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 5, None), (0, 4, 3), (1, 1, 0)], "doc_id int, mention int, antecedent int")
    assert sorted((r.doc_id, r.cluster, tuple(r.mentions)) for r in B.coreference_clusters(links).collect()) == [(0, 0, (0, 1, 2)), (0, 1, (3, 4)), (1, 0, (0, 1))]
    buckets = spark.createDataFrame([(i,) for i in (0, 1, 4, 5, 7, 8, 15, 16, 31, 32, 63, 64, 999)], "d int").select(B.bucket_distance(F.col("d"))).collect()
    assert [r[0] for r in buckets] == [0, 1, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9]
    s = B.segments([([1, 2, 3], [True, True, False], [[0], [0], []]), ([4, 5, 6, 7, 8], [True, True, False, True, False], [[], [1], [1], [0], []])], 5, 101, 102)
    assert s["segments"] == [[101, 1, 2, 3, 102], [101, 4, 5, 6, 102], [101, 7, 8, 102]]
    assert s["sentence_map"] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1]
    assert list(zip(s["starts"], s["ends"], s["clusters"])) == [(1, 2, 0), (7, 8, 1), (11, 11, 0)]


def test_dependencies_take_no_shuffle_before_the_count(spark):
    """Sentences are worked on in their own tasks; counts are those of the rows."""
    docs = spark.createDataFrame([(i, SENT) for i in range(3)], "doc_id int, value string")
    sents = S.conll_sentences(docs, fields=S.CONLLU)
    for k in ({"labels": True}, {"depth": 3, "directed": True}, {"collapse": True, "labels": True}, {"pos_keep": "NN"}):
        rows = X.Dependency(**k)(sents)
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        want = rows.groupBy("word", "ctx").agg(F.count(F.lit(1)).alias("n"))
        assert sorted(map(tuple, X.Dependency(**k).counted(sents).collect())) == sorted(map(tuple, want.collect()))
    twice = X.Custom(lambda t: [[x, x] for x in t[1:]])
    assert sorted(map(tuple, twice.counted(S.from_iterable(spark, ["a b a b"])).collect())) == [("a", "b", 4), ("b", "a", 2)]
