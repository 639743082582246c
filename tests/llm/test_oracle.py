import pytest

from lexigrid.llm import queries
from tests import comparing

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_agrees_with_its_sql(spark, name):
    assert comparing.differences(queries.QUERIES[name](spark, DIR), queries.ORACLE[name], DIR) == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_reads_the_whole_table(spark, name):
    import inspect

    source = inspect.getsource(queries.QUERIES[name])
    assert ".limit(" not in source and ".sample(" not in source
