"""Every registered query with SQL of its own gives the rows of that SQL on the smallest tables; the others run."""

import pytest

from tests.compare import connection, difference
from weftline.plans.queries import QUERIES, SQL

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(TABLES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, TABLES), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, TABLES).limit(1).count() == 1
