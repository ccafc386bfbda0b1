"""Every query with SQL gives what the SQL gives."""

import os

import pytest

from sparkdecide import catalog
from tests import oracle


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    got = oracle.rows(catalog.QUERIES[name](spark, oracle.SF).toPandas())
    want = oracle.rows(oracle.connect().execute(catalog.ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables here")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
