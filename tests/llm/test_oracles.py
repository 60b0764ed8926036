"""Registered queries against their SQL, as the driver compares them."""

import duckdb
import pytest

from scrubjay.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tools.check_oracle import canon


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    columns = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want) > 0
    assert canon(df.columns, got) == canon(columns, want)
