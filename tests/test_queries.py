"""Every query of the core against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, assert_equal, connection

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
CORE = {k: v for m in entry._modules() if m.__name__.startswith("framewright.plans.") for k, v in m.QUERIES.items()}
SQL = {k: v for m in entry._modules() if m.__name__.startswith("framewright.plans.") for k, v in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert_equal(spark, name, CORE[name], SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_runs(spark, name):
    assert CORE[name](spark, str(DATA)).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["face_id", "kind", "from_ms", "to_ms"]
