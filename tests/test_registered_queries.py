"""Every registered query against its SQL on the smallest supplied tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.compare import compare, views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables not present")


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_sql(spark, con, name):
    ok, note, _ = compare(spark, con, name, SF)
    assert ok, note
    assert "types" not in note, note


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 20
