import pytest

from orbitquery.plans import catalogue, geometry  # noqa: F401  geometry adds its queries to the catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_oracle(spark, sf_dir, oracle, same, name):
    same(catalogue.QUERIES[name](spark, sf_dir), oracle.sql(catalogue.ORACLE[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
