import pytest

import __spark_entry__ as entry
from portlight import queries as core

from . import oracle


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    oracle.compare(spark, core.QUERIES[name], core.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, oracle.SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
