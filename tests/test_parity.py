import pytest

from lamella.plans import registry
from tests.conftest import SMALL
from tests.parity import same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        assert df.count() > 0
