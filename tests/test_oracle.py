"""Every registered query with reference SQL must equal DuckDB at sf0.001."""

import pytest

from conftest import SF001

import __spark_entry__ as entry
from tools.oracle_check import compare, duck

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, con, name):
    msg = compare(name, entry.queries()[name](spark, SF001), con, SQL[name])
    assert msg.startswith("OK") and "TYPES" not in msg, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 31
    assert df.columns == ["series_id", "year", "prev_year", "basis", "n_common_weeks", "sales_curr",
                          "sales_prev", "growth", "is_partial"]
