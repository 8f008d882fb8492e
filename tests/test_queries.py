"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import __spark_entry__ as e
import pytest

from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
ORACLES = e.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(e.queries()))
def test_query(spark, con, name):
    result = e.queries()[name](spark, SF)
    if name in ORACLES:
        assert difference(result, con, ORACLES[name]) is None
    else:
        assert result.count() > 0


def test_entry(spark):
    assert e.entry(spark).columns == ["page_id", "title", "content"]


def test_names():
    assert set(ORACLES) <= set(e.queries())
