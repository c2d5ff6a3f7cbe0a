"""Every query of the library against its SQL at the smallest scale.

The queries of the optional package for training text have tests of their own.
"""

import os

import pytest

from compare import compare, duck
from labelloom.workload.oracle import SQL
from labelloom.workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


#: Queries beyond SQL, and the test that stands in for it.
NO_SQL = {"tune_search_guided": "test_guided.test_a_resumed_search_equals_an_uninterrupted_one"}


def test_every_query_has_sql():
    assert set(QUERIES) - set(NO_SQL) == set(SQL)


@pytest.mark.parametrize("name", NO_SQL)
def test_query_without_sql_is_repeatable(spark, name):
    rows, again = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert rows == again and rows


@pytest.mark.parametrize("name", SQL)
def test_query(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], SQL[name]) is None
