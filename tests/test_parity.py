import pytest
from parity import assert_parity

from rillsum.plans import oracle, queries

Q, O = queries.queries(), oracle.oracle_sql()


def test_every_query_has_sql():
    assert set(Q) == set(O)


@pytest.mark.parametrize("name", sorted(Q))
def test_parity(spark, sf, name):
    assert_parity(spark, sf, Q[name], O[name])
