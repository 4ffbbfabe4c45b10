import oracle
import pytest

from tallyspark.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, oracle.connection(), queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_there_is_a_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
