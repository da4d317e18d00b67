"""Relational tables by JDBC (Derby, which comes with Spark) and keyed tables in buckets."""

import uuid

import pytest
from pyspark.sql import functions as F

from weftbase.operators import store
from weftbase.sources import tables


@pytest.fixture
def url(tmp_path):
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def test_round_trip_in_even_ranges(spark, url):
    # two clusters of keys far apart, as ranges of equal width would not divide them
    keys = F.when(F.col("id") < 9_000, F.col("id")).otherwise(F.col("id") + 50_000_000)
    df = spark.range(10_000).select(keys.alias("ID"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("NAME"), (F.col("id") % 7).cast("int").alias("KIND"))
    df.coalesce(2).write.format("jdbc").options(url=url, dbtable="DOCS").save()
    got = tables.read_jdbc(spark, url, "DOCS", "ID", rows=1_000)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.rdd.getNumPartitions() == 10 and sizes == [1_000] * 10
    assert got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty()


def test_text_keys_null_keys_and_small_tables(spark, url):
    rows = [(f"k'{i:03}", i if i % 10 else None) for i in range(100)]
    spark.createDataFrame(rows, "K string, V long").coalesce(1).write.format("jdbc").options(url=url, dbtable="T", createTableColumnTypes="K VARCHAR(20)").save()
    for key in ("K", "V"):
        for n in (20, 1_000):
            assert sorted(tuple(r) for r in tables.read_jdbc(spark, url, "T", key, rows=n).collect()) == rows


def test_upsert(spark, url):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "ID long, NAME string, EXTRA int")
    old.coalesce(1).write.format("jdbc").options(url=url, dbtable="D", createTableColumnTypes="NAME VARCHAR(20)").save()
    new = spark.createDataFrame([(2, "new"), (3, "c")], "id long, name string")
    for _ in range(2):
        tables.upsert_jdbc(new, url, "D")
        assert sorted(tuple(r) for r in tables.read_jdbc(spark, url, "D", "ID").collect()) == [(1, "a", 10), (2, "new", 20), (3, "c", None)]
    with pytest.raises(Exception):
        tables.upsert_jdbc(spark.createDataFrame([(1, "x", 1)], "id long, name string, unknown int"), url, "D")
    assert [tuple(r) for r in tables.read_jdbc(spark, url, "D", "ID").filter("ID = 1").collect()] == [(1, "a", 10)]


def test_keyed_store_joins_where_it_lies(spark):
    names = [f"keyed_{uuid.uuid4().hex}" for _ in range(2)]
    made = spark.range(2_000).select((F.col("id") % 900).alias("chunk_id"), F.col("id").alias("pos"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("entry_id"), F.repeat(F.lit("x"), 50).alias("text"))
    chunks = spark.range(1_000).select(F.col("id").alias("chunk_id"), (F.col("id") * 2).alias("size"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entries, table = tables.write_keyed(made, names[0], buckets=4), tables.write_keyed(chunks, names[1], buckets=4)
        exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        left, right = table.join(entries, "chunk_id", "left_anti"), chunks.join(made, "chunk_id", "left_anti")
        assert exchanges(left) == 0 and exchanges(right) == 2
        assert sorted(r["chunk_id"] for r in left.collect()) == list(range(900, 1_000))
        first = store.first_by_chunk(entries)
        assert exchanges(first) == 0
        assert sorted((r["chunk_id"], r["pos"]) for r in first.collect()) == [(i, i) for i in range(900)]
        # new rows move to the store, not the store to them
        assert exchanges(store.upsert(entries.withColumnRenamed("chunk_id", "k"), spark.range(5).select(F.col("id").alias("k"), F.lit("n").alias("entry_id")), "k")) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_first_by_chunk_with_one_hot_id(spark):
    rows = [("x", i, f"e{i}") for i in range(3_000)] + [("1", 5, "a"), ("1", 4, "b"), (None, 0, "n")]
    df = spark.createDataFrame(rows, "chunk_id string, pos long, entry_id string").repartition(6)
    got = store.first_by_chunk(df)
    assert sorted(tuple(r) for r in got.collect()) == [("1", 4, "b"), ("x", 0, "e0")]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
