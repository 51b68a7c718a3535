import pytest

from lectern.plans import ORACLES, PLANS

from .compare import connect, duck_rows, spark_rows
from .conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_same_rows_as_sql(name, spark, con):
    found = spark_rows(PLANS[name](spark, SMALL))
    if name in ORACLES:
        assert found == duck_rows(con, ORACLES[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["chunk_id", "fused", "lists"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
