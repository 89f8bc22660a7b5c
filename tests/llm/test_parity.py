import pytest

from lamella.llm.queries import QUERIES
from lamella.llm.sql import SQL
from tests.conftest import SMALL
from tests.parity import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    same(QUERIES[name](spark, SMALL), duck, SQL[name])
