"""Every query with an oracle gives DuckDB's rows on the smallest tables; the others give rows, alike in two runs."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from weftbase.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = sorted(([plain(v) for v in r] for r in df.collect()), key=repr)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert got == sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    rows = lambda: sorted(map(repr, entry.queries()[name](spark, sf_dir).collect()))
    first = rows()
    assert first and first == rows()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "pos", "place", "score"] and df.count() > 0
