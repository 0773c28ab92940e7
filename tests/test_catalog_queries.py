import pytest

from orrery import catalog_queries
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog_queries.queries()))
def test_query(spark, name):
    df = catalog_queries.queries()[name](spark, SF)
    if name in catalog_queries.oracle_sql():
        compare(df, catalog_queries.oracle_sql()[name], SF)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
