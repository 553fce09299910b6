"""Corpus queries that SQL can express give the rows of their DuckDB twins."""

from __future__ import annotations

import duckdb
import pytest

from leafmill.llm import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    twin = con.execute(ORACLES[name])
    names = [c[0] for c in twin.description]
    got = QUERIES[name](spark, DATA).select(*names).collect()
    key = lambda r: [str(v) for v in r]
    assert sorted((tuple(r) for r in got), key=key) == sorted(twin.fetchall(), key=key)
