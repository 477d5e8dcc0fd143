import pytest

from orbitquery.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, sf_dir, oracle, same, name):
    same(queries.QUERIES[name](spark, sf_dir), oracle.sql(queries.ORACLE_SQL[name]))
