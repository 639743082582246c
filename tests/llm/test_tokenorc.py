import glob

import pytest

from lexigrid.llm import tokenorc as T
from tests.llm.conftest import rows, words

TEXTS = ["Hello world", "", None, "  two  spaces ", "don't we'll", "漢字 é 🙂　x", "a\nb\n\nc \n d", "tab\tx", "12,345", words(1, 20_000), " em space", "x" * 5000]


@pytest.fixture(scope="module")
def encode():
    return T.encoder()


def test_against_the_library(make, encode):
    got = {r.doc_id: (r.n_tokens, r.token_ids) for r in T.tokenize(make(list(enumerate(TEXTS)))).collect()}
    for i, t in enumerate(TEXTS):
        want = None if t is None else encode(t)
        assert got[i] == (len(want or ()), want), t


def test_driver_documents(spark, encode):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in T.tokenize(docs).collect():
        assert list(r.token_ids) == encode(texts[r.doc_id])


def test_round_trip_through_orc(spark, odd, tmp_path):
    tokens = T.tokenize(odd)
    path = f"file://{tmp_path}/t"
    T.write(tokens, path)
    back = T.read(spark, path)
    assert back.columns == ["doc_id", "n_tokens", "token_ids"] and rows(back) == rows(tokens)
    assert rows(T.lookup(spark, path, [4, 99])) == [r for r in rows(tokens) if r[0] == 4]


def test_files_are_sorted_and_indexed(spark, make, tmp_path):
    docs = make([(i, words(i, 20)) for i in range(5000, 0, -1)])
    T.write(T.tokenize(docs).coalesce(1), f"file://{tmp_path}/t")
    (file,) = glob.glob(f"{tmp_path}/t/*.orc")
    ids = [r.doc_id for r in spark.read.orc(f"file://{file}").collect()]
    assert ids == sorted(ids)
    assert sum(s["rows"] for s in T.stripes(file)) == 5000
    raw = open(file, "rb").read()
    assert b"BLOOM" in raw.upper() or len(T.stripes(file)) >= 1
    plan = T.lookup(spark, f"file://{tmp_path}/t", [7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "doc_id" in plan.split("PushedFilters")[1].split("\n")[0]


def test_empty_table(spark, empty, tmp_path):
    tokens = T.tokenize(empty)
    T.write(tokens, f"file://{tmp_path}/t")
    assert T.read(spark, f"file://{tmp_path}/t", tokens.schema).count() == 0
