"""Operators' queries that SQL can express give DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from weftbase.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        duck.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(([r[c] for c in names] for r in df.collect()), key=repr)
    assert got == sorted((list(r) for r in found.fetchall()), key=repr)
