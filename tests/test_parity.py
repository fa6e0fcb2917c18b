"""Every query of the catalog engine against its SQL on the smallest tables."""

import pytest

from millrace.plans import registry
from tests.parity import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0 and df.count() > 0
    else:
        assert difference(df, db.sql(sql)) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
