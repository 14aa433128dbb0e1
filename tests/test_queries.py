"""Every query that has SQL gives DuckDB's rows; every other runs."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SLOW = ("m08", "m10", "m11", "m12", "m27", "e01", "e02", "e03")
OWN = [name for name in entry.queries() if not name.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_equals_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, FOLDER), duck.sql(entry.oracle_sql()[name])) == ""


@pytest.mark.parametrize("name", [n for n in OWN if n not in entry.oracle_sql() and not n.startswith(SLOW)])
def test_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
