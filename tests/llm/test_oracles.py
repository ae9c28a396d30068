"""Queries with SQL against DuckDB on the smallest tables (row count and values)."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_oracle import TABLES, digest  # noqa: E402
from conftest import SF  # noqa: E402

from tenura.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, key):
    df = QUERIES[key](spark, SF)
    rows, cols = df.collect(), df.columns
    r = duck.execute(ORACLES[key])
    ocols = [d[0] for d in r.description]
    orows = r.fetchall()
    assert sorted(cols) == sorted(ocols) and len(rows) == len(orows)
    assert digest(cols, rows)[0] == digest(ocols, orows)[0]
