"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest

from tessera.plans.registry import registered
from tests.oracle import connect, rows

QUERIES = registered()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_matches_sql(spark, sf_dir, con, name):
    mine = QUERIES[name].run(spark, sf_dir).toPandas()
    theirs = con.execute(QUERIES[name].sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
    assert len(mine) > 0


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name].run(spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
