"""Every registered query against its SQL twin on DuckDB, at the smallest scale."""

import math

import duckdb
import pytest
from conftest import SF

from weirflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    out = duck.execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[k]) for k in place) for r in out.fetchall()), key=repr)
    assert got == want
