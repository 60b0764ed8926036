"""Every registered query against its DuckDB oracle (sf0.001), the way the
driver's correctness gate compares them: column names, row count and
order-insensitive values."""

import duckdb
import pytest

from tests.conftest import SF_SMALL
from tools.check_oracle import canon

import __spark_entry__ as entry

QUERIES = dict(entry.registry.QUERIES)
ORACLE = dict(entry.registry.ORACLE)


@pytest.fixture(scope="module")
def duck():
    from scrubjay.suite.fixtures import TABLES
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_documented():
    rows_only = set(QUERIES) - set(ORACLE)
    assert not rows_only
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["category", "value"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert canon(s_cols, s_rows) == canon(d_cols, d_rows)
