"""The pipeline as a whole, against the stages' brute-force versions one after the other."""

import corpus_pipeline as C
from lexigrid.llm import packing, pii, quality
from tests.llm import test_neardup, test_packing, test_quality

DIR = "/root/testdata/sf0.001"


def test_stages_are_in_order():
    assert [n for n, _ in C.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "pii", "best_fit_packing"]


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = [r for r in docs.orderBy("doc_id").collect() if not test_quality.reasons(r.text)]
    seen, single = set(), []
    for r in kept:
        if r.text not in seen:
            seen.add(r.text)
            single.append(r)
    frame = spark.createDataFrame(single, docs.schema)
    gone = {i for i, _ in test_neardup.brute(frame)}
    left = [r for r in single if r.doc_id not in gone]
    model = pii.fit_on(spark.createDataFrame(left, docs.schema))
    texts = {r.doc_id: pii.redact(r.text, pii.entities(r.text, model)) for r in left}
    got = sorted(tuple(r) for r in C.run(spark, DIR).collect())
    assert {r[2] for r in got} == {i for i, t in texts.items() if t.split()}  # no near copy of these tables is missed
    assert got == sorted(test_packing.packed([(i, len(t.split())) for i, t in texts.items()], packing.CAPACITY))


def test_columns_and_effects(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    assert quality.keep(docs).count() < docs.count()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, DIR).count() == 0
