"""Every value-checked query against its DuckDB oracle on the smallest scale factor.

(The project's correctness gate runs the same comparison at sf0.01.)
"""

import pytest

import __spark_entry__ as entry
from tripstar.checks import compare, duckdb_connection

from conftest import SMOKE

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SMOKE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    res = compare(spark, SMOKE, name, entry.queries()[name], SQL[name], con)
    assert res["status"] == "ok", res
