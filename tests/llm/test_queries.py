import pytest

from orrery.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    compare(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")] == list(range(1, 11))
