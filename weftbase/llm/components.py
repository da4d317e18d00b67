"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftbase.llm.scratch import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the least node reachable.

    Each round hangs nodes under smaller ones and is written to the shared folder. Sums of what a round
    leaves tell whether it changed anything; rounds go on until none does. No edges: no rows.
    """
    now = keep(_distinct(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        under = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(under, "a").select("b", "m").filter("b != m").toDF("a", "b").union(under.select("a", "m").toDF("a", "b"))
        now = keep(_distinct(small), "edges", free=True)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").distinct()


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1 << 40))), F.sum(F.pmod(F.shiftright(h, 24), F.lit(1 << 40)))).head())
