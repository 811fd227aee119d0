"""Every catalogue query against its SQL on DuckDB, on the smallest tables."""

import pytest

from compare import difference, oracle
from conftest import SMALL
from pricepanel.plans.catalog import CATALOGUE


@pytest.fixture(scope="module")
def con():
    return oracle(SMALL)


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query(spark, con, name):
    q = CATALOGUE[name]
    got = q.run(spark, SMALL).toPandas()
    assert list(got.columns)
    if q.sql:
        assert difference(got, con.execute(q.sql).df()) is None
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
