"""Every query with SQL equals what DuckDB makes of the same tables."""

import os

import pytest
from oracle import connect, differences

from millrace.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert differences(df, ORACLE_SQL[name], con) is None
    else:
        df.count()
