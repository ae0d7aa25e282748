"""Every query of the problems over empty tables and over nulls in any column."""

import pytest

from framewright.llm import queries
from tests.edges import write
from tests.oracle import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return write(tmp_path_factory.mktemp("edges"))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, folder, name):
    assert queries.QUERIES[name](spark, str(folder / "empty")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_nulls_and_repeats(spark, folder, name):
    assert queries.QUERIES[name](spark, str(folder / "nulls")).count() >= 0
