"""Every query of the catalog against its SQL, on the smallest tables."""

import pytest

from lexigrid.plans import catalog
from tests import comparing

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_agrees_with_its_sql(spark, name):
    assert comparing.differences(catalog.QUERIES[name](spark, DIR), catalog.ORACLE[name], DIR) == []


def test_queries_without_sql(spark):
    """Seeded and iterative queries: the same rows each time, and what holds for every result."""
    a, b = (comparing.spark_rows(catalog.QUERIES["subsampled_counts"](spark, DIR)) for _ in range(2))
    assert a == b
    masked = catalog.QUERIES["masked_tokens"](spark, DIR)
    n, chosen = masked.count(), masked.where("label >= 0").count()
    assert 0.13 < chosen / n < 0.17 and masked.where("label < 0 and input_id <> token_id").count() == 0
    pairs = catalog.QUERIES["next_sentences"](spark, DIR)
    assert 0.4 < pairs.where("label = 1").count() / pairs.count() < 0.6
    exact = {(r.a, r.b): r.distance for r in catalog.QUERIES["word_mover_distance"](spark, DIR).collect()}
    low = {(r.a, r.b): r.distance for r in catalog.QUERIES["wmd_relaxed"](spark, DIR).collect()}
    assert exact.keys() == low.keys() and all(low[k] <= exact[k] + 1e-6 for k in exact)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["word", "ctx", "value"]
    assert set(e.oracle_sql()) <= set(e.queries())
