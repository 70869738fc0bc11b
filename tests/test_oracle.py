"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from threadlens.testing import compare, duckdb_views

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = compare(df, con, SQL[name])
    assert res["columns_match"], res
    assert res["values_match"], res


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "conversation_id", "count", "rank", "topic"]
    assert df.count() > 0
