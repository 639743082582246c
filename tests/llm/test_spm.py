import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from lexigrid.llm import spm as S
from tests.llm.conftest import words

P = S.load()
TEXTS = ["Hello world", "", None, " leading", "two  spaces", "x" * 500, "漢字 é 🙂 naïve", "tab\tand\nline", "a" * 61 + " " + "b" * 63, "🙂" * 70, "▁ raw", "The the THE", "\x00\x01", words(1, 3000), "1234567890 3.14"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def test_against_the_library(make, library):
    got = {r.doc_id: r.ids for r in S.encode(make(list(enumerate(TEXTS))), P).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == (None if text is None else library.encode(text) if text else []), text


def test_driver_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = S.encode(docs, P).withColumn("decoded", S.decode(F.col("ids"), P)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert list(r.ids) == library.encode(texts[r.doc_id])
        assert r.decoded == texts[r.doc_id]


@pytest.fixture(scope="module")
def viterbi_library(library):
    """The library with the same pieces as a Unigram model: the model file with another model type."""
    import sentencepiece

    raw, i, out = library.serialized_model_proto(), 0, b""

    def varint(b, i):
        v = s = 0
        while True:
            v |= (b[i] & 127) << s
            s, i = s + 7, i + 1
            if b[i - 1] < 128:
                return v, i

    def number(n):
        return bytes([n & 127 | 128]) + number(n >> 7) if n > 127 else bytes([n])

    while i < len(raw):
        start = i
        tag, i = varint(raw, i)
        n, i = varint(raw, i)
        i += n
        if tag >> 3 == 2:  # the trainer's settings; of a field given twice the last one counts
            body = raw[i - n : i] + b"\x18\x01"
            out += number(tag) + number(len(body)) + body
        else:
            out += raw[start:i]
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def score(ids, text):
    """The score of a path: of its pieces, and of each character spelled in bytes that of an unknown one."""
    low = min(x for x, u in zip(P.scores, P.usable) if u) - 10
    spelled = bytes(i - P.byte0 for i in ids if P.byte0 <= i < P.byte0 + 256).decode()
    return sum(P.scores[i] for i in ids if not P.byte0 <= i < P.byte0 + 256) + low * len(spelled)


def test_viterbi_against_the_library(make, library, viterbi_library):
    """The best of the library's n best paths; its quick search misses some of these."""
    got = {r.doc_id: list(r.ids) for r in S.encode(make([(i, t) for i, t in enumerate(TEXTS) if t and len(t) < 200]), S.unigram(P)).collect()}
    for i, ids in got.items():
        assert score(ids, TEXTS[i]) == pytest.approx(score(viterbi_library.nbest_encode_as_ids(TEXTS[i], 3)[0], TEXTS[i])), TEXTS[i]
        assert viterbi_library.decode(ids) == library.decode(library.encode(TEXTS[i]))
    assert any(ids != library.encode(TEXTS[i]) for i, ids in got.items())


def test_viterbi_query(spark):
    """Whole texts, against Viterbi over each text at once, which knows no words."""
    from lexigrid.llm.queries import sentencepiece_viterbi

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ranks = {s: (i, x) for i, (s, x, u) in enumerate(zip(P.pieces, P.scores, P.usable)) if u}
    rows_ = sentencepiece_viterbi(spark, "/root/testdata/sf0.001").collect()
    assert len(rows_) == len(texts)
    for r in rows_:
        if texts[r.doc_id] and len(texts[r.doc_id]) < 3000:
            want = S.best_path(f" {texts[r.doc_id]}".replace(" ", S.SPACE), ranks, P)
            assert score(r.ids, None) == pytest.approx(score(want, None), rel=1e-12)


@pytest.mark.parametrize("part", [S.PART_BYTES, 20_000])
def test_behind_a_shuffle_and_from_files(spark, make, tmp_path, library, monkeypatch, part):
    """Texts from files, of which each task has a part, and texts behind a shuffle give the same ids."""
    monkeypatch.setattr(S, "PART_BYTES", part)
    texts = [words(i, 300, 26**4) for i in range(60)]
    make(list(enumerate(texts))).coalesce(2).write.option("parquet.block.size", 16_000).parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        docs = spark.read.parquet(f"{tmp_path}/t")
        assert S._from_files(docs.where("doc_id >= 0").select("doc_id", "text")) and not S._from_files(docs.repartition(3, "doc_id")) and docs.rdd.getNumPartitions() > 4
        for frame in (docs, docs.repartition(3, "doc_id"), docs.groupBy("doc_id").agg(F.max("text").alias("text"))):
            assert {r.doc_id: list(r.ids) for r in S.encode(frame, P).collect()} == {i: library.encode(t) for i, t in enumerate(texts)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("kind", [S.BPE, S.UNIGRAM])
def test_dictionaries_are_bounded_within_a_row_group(spark, make, tmp_path, monkeypatch, kind):
    """One row group is one task and has one place in its file, however large it is: what a worker holds of its words is bounded all the same."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(S, "PART_TEXT", 20_000, raising=False)
    monkeypatch.setattr(S.C, "shared_dir", lambda spark, name: f"file://{tmp_path}/{name}")
    p, texts = dataclasses.replace(P, kind=kind), [words(i, 300, 26**4) for i in range(60)]
    make(list(enumerate(texts))).coalesce(1).write.parquet(f"{tmp_path}/t")
    got = {r.doc_id: list(r.ids) for r in S.encode(spark.read.parquet(f"{tmp_path}/t"), p).collect()}
    alone, ranks = S.merge_steps if kind == S.BPE else S.best_path, {s: (i, x) for i, (s, x, u) in enumerate(zip(P.pieces, P.scores, P.usable)) if u}
    assert {i: len(ids) for i, ids in got.items()} == {i: sum(len(alone(f"{S.SPACE}{w}", ranks, p)) for w in t.split()) for i, t in enumerate(texts)}
    held = [sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{tmp_path}/dictionaries/f=*")]
    assert sum(held) > 17_000 and max(held) < 4_500, held


def test_places_in_a_dictionary_of_several_chunks():
    import pyarrow as pa

    kinds = pa.array(["b", "zz", "a", "", "d"])
    assert S._places(kinds, pa.chunked_array([["a", "x"], [], ["y", "b"], [""]], pa.string())).tolist() == [3, -1, 0, 4, -1]
    assert S._places(kinds, pa.chunked_array([], pa.string())).tolist() == [-1] * 5


def test_decoding_of_malformed_ids(spark):
    df = spark.createDataFrame([(0, [P.byte0 + 0xC3]), (1, [P.byte0 + 0xC3, P.byte0 + 0xA9]), (2, [10**6, 1]), (3, []), (4, None), (5, [P.byte0 + 0xFF, P.byte0 + 65])], "i int, ids array<int>")
    got = {r.i: r.t for r in df.select("i", S.decode(F.col("ids"), P).alias("t")).collect()}
    assert got == {0: "\ufffd", 1: "é", 2: "", 3: "", 4: None, 5: "\ufffdA"}


def test_round_trip(make):
    df = S.encode(make(list(enumerate(TEXTS))), P).withColumn("t", S.decode(F.col("ids"), P))
    got = {r.doc_id: r.t for r in df.collect()}
    assert got == {i: t for i, t in enumerate(TEXTS)} | {10: "  raw"}  # the space mark itself reads as a space


def test_odd_rows_and_empty_table(odd, empty):
    got = S.encode(odd, P)
    assert got.columns == ["doc_id", "ids"] and got.count() == odd.count()
    ids = [tuple(r.ids) for r in got.collect() if r.doc_id == 1]
    assert len(ids) == 2 and ids[0] == ids[1]
    assert S.encode(empty, P).count() == 0


PIECES = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca"]
SCORES = [0.0, -3.0, -2.0, -2.5, -2.2, -3.1, -3.4, -5.0, -2.9, -3.5, -3.05]
TOY = S.Pieces(S.UNIGRAM, tuple(PIECES), tuple(SCORES), tuple(i > 0 for i in range(len(PIECES))), -1, 0)


def brute(word, p):
    """The best of all segmentations."""
    ranks = {s: (x, i) for i, (s, x, u) in enumerate(zip(p.pieces, p.scores, p.usable)) if u}
    low = min(x for x, _ in ranks.values()) - 10

    def go(s):
        if not s:
            return 0.0, ()
        best = None
        for n in range(1, len(s) + 1):
            x = ranks.get(s[:n], (low, p.unk) if n == 1 else None)
            if x is not None:
                score, rest = go(s[n:])
                if best is None or score + x[0] > best[0] + 1e-12:
                    best = (score + x[0], (x[1], *rest))
        return best

    return go(word)


def test_viterbi_against_all_segmentations(spark):
    r = random.Random(2)
    kinds = sorted({"".join(r.choices("abcx", k=r.randint(1, 9))) for _ in range(120)} | {" " + "".join(r.choices("abc", k=5)) for _ in range(30)})
    df = spark.createDataFrame([(w,) for w in kinds], "word string")
    got = {x.word: x.ids for x in S.fold(S.lattice(df, TOY), TOY).collect()}
    rank = dict(zip(range(len(PIECES)), SCORES))
    low = min(SCORES[1:]) - 10
    score = lambda ids: sum(rank[i] if i else low for i in ids)
    for w in kinds:
        assert score(got[w]) == pytest.approx(brute(w.replace(" ", S.SPACE), TOY)[0]), w
        assert S.best_path(w.replace(" ", S.SPACE), {s: (i, x) for i, (s, x) in enumerate(zip(PIECES, SCORES)) if i}, TOY) == got[w]


def test_fold_of_merges_is_what_steps_give(spark):
    r = random.Random(3)
    kinds = sorted({"".join(r.choices("abcehilnorst ", k=r.randint(1, 40))) for _ in range(200)})
    ranks = {s: (i, x) for i, (s, x, u) in enumerate(zip(P.pieces, P.scores, P.usable)) if u}
    for x in S.fold(S.lattice(spark.createDataFrame([(w,) for w in kinds], "word string"), P), P).collect():
        if x.ids is not None:
            assert x.ids == S.merge_steps(x.word.replace(" ", S.SPACE), ranks, P)


def test_unknown_characters_without_bytes(make):
    toy = dataclasses.replace(TOY, prefix=False)
    got = S.encode(make([(1, "abz"), (2, "c")]), toy)
    assert {r.doc_id: r.ids for r in got.collect()} == {1: [5, 0], 2: [4]}
