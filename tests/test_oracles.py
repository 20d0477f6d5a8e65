import pytest
from conftest import DATA

from quarryline.plans import catalogue


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(name, against_sql):
    against_sql(catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(name, spark):
    df = catalogue.QUERIES[name](spark, str(DATA))
    assert df.columns
    df.count()


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry_point_has_all_of_them():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
