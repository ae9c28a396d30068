"""Every registered query against its DuckDB oracle at sf0.001 (row count + values)."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402

from tenura.plans.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
KEYS = sorted(QUERIES)      # the library's own; tests/llm covers that subpackage
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_key_has_an_oracle():
    assert set(KEYS) == set(ORACLES)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF)
    rows, cols = df.collect(), df.columns
    r = duck.execute(ORACLES[key])
    ocols = [d[0] for d in r.description]
    orows = r.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(cols, rows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "title_no" in df.columns
