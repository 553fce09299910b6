"""Every query with a DuckDB twin gives the twin's rows; every other one runs and has the same columns twice."""

from __future__ import annotations

import duckdb
import pytest

from leafmill.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, order):
    value = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    twin = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in twin.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    got = plain(df.collect(), [df.columns.index(c) for c in columns])
    assert got == plain(twin.fetchall(), [names.index(c) for c in columns])


#: Names that stand for one function are run once.
SINGLE = {q: name for name, q in reversed(sorted(catalogue.QUERIES.items())) if name not in catalogue.ORACLES}


@pytest.mark.parametrize("name", sorted(SINGLE.values()))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
