"""Every query that has SQL is compared with DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check import rows_of

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for path in sorted(SF_DIR.glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_against_sql(spark, connection, name):
    df = entry_module.queries()[name](spark, str(SF_DIR))
    result = connection.sql(entry_module.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(result.columns, result.fetchall())


def test_entry(spark):
    out = entry_module.entry(spark)
    assert "corrected_slope" in out.columns and out.count() > 0
