"""Batch search: exact vector top-k, hybrid re-ranking, placement, and the context of an answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftbase.operators.store import TOPIC_PATTERNS

SHARD = 20_000
QUERY_BLOCK = 256


def normalized(v: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def block_topk(queries: DataFrame, entries: DataFrame, pool: int) -> DataFrame:
    """(query_id, entry_id, pos, dist, rank): the ``pool`` nearest entries of each query by squared L2 distance,
    ties by position. Entries are shuffled once into shards of about SHARD rows, and every shard gets all queries
    after its entries, so a task holds one shard and a block of queries; only a pool per shard and query is
    exchanged. Null vectors take no part."""
    spark = queries.sparkSession
    n = entries.count()
    shards = max(-(-n // SHARD), min(spark.sparkContext.defaultParallelism, -(-n // 1000)), 1)
    vector = F.col("vector").cast("array<double>").alias("vector")
    rows = entries.filter("vector is not null").select(F.pmod(F.xxhash64("entry_id", "pos"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("query_id"), "entry_id", "pos", vector)
    asked = queries.filter("vector is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), F.col("query_id").cast("long").alias("query_id"), F.lit("").alias("entry_id"), F.lit(0).cast("long").alias("pos"), vector)
    met = rows.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = met.mapInPandas(_nearest(pool), "query_id long, entry_id string, pos long, dist double")
    best = Window.partitionBy("query_id").orderBy("dist", "pos", "entry_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= pool)


def _nearest(pool: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, side = None, [], None
        for pdf in batches:
            for (at, kind), part in pdf.groupby(["shard", "kind"], sort=True):
                if at != shard:
                    shard, held, side = at, [], None
                if kind == 0:
                    held.append((part["entry_id"].to_numpy(), part["pos"].to_numpy(), np.array(part["vector"].tolist(), np.float64)))
                    continue
                if not held:
                    continue
                if side is None:
                    side = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held = held[:1]
                for start in range(0, len(part), QUERY_BLOCK):
                    block = part.iloc[start : start + QUERY_BLOCK]
                    yield _pools(block["query_id"].to_numpy(), np.array(block["vector"].tolist(), np.float64), *side, pool)

    return run


def _pools(ids: np.ndarray, q: np.ndarray, entry_ids: np.ndarray, pos: np.ndarray, x: np.ndarray, pool: int) -> pd.DataFrame:
    """The pool of each query: a matrix product finds who can be in it, the exact distance decides."""
    k = min(pool, len(x))
    norms, own = (x * x).sum(1), (q * q).sum(1)
    near = norms[None, :] - 2.0 * (q @ x.T)
    reach = np.partition(near, k - 1, axis=1)[:, k - 1] + 1e-9 * (1.0 + own + norms.max())
    out = []
    for i in range(len(q)):
        at = np.flatnonzero(near[i] <= reach[i])
        d = ((x[at] - q[i]) ** 2).sum(1)
        top = np.lexsort((entry_ids[at], pos[at], d))[:k]
        out.append((at[top], d[top]))
    at = np.concatenate([a for a, _ in out])
    return pd.DataFrame({"query_id": np.repeat(ids, k), "entry_id": entry_ids[at], "pos": pos[at], "dist": np.concatenate([d for _, d in out])})


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))


def rerank(hits: DataFrame, vocabulary: tuple[str, ...] = (), url_terms: tuple[str, ...] = (), patterns: tuple[str, ...] = TOPIC_PATTERNS) -> DataFrame:
    """``hits`` (query_id, query, entry_id, dist, rank, text, title, url, source_type, page_number) with score:
    the distance less what the rules grant, never below 0. Websites have rules of their own; those on the
    domain's vocabulary grant 0.30 at most."""
    q, text, title, url = F.col("_q"), F.lower(F.col("text")), F.lower(F.coalesce("title", F.lit(""))), F.coalesce("url", F.lit(""))
    rows = hits.withColumn("_q", words(F.col("query"))).withColumn("_shared", F.size(F.array_intersect(words(F.col("query")), words(F.col("text")))))
    start = F.greatest(F.col("dist") - 0.15 * F.col("_shared"), F.lit(0.0))
    nav = F.contains("text", F.lit("Menu/Navigation:")) | F.contains("text", F.lit("Header:"))
    topic = F.lit(False)
    name = F.lit(None).cast("string")
    for p in reversed(patterns):
        here = F.contains(url, F.lit(p))
        topic = topic | here
        name = F.when(here, F.regexp_replace(F.regexp_replace(F.element_at(F.split(url, p), 2), "^/+|/+$", ""), "[-_]", " ")).otherwise(name)
    named = F.exists(F.filter(F.split(F.lower(name), " "), lambda w: w != ""), lambda w: F.contains(F.lower("query"), w))
    page = F.coalesce(F.col("page_number"), F.lit(0))
    inside = F.exists(q, lambda t: F.contains(text, t))
    terms = F.array(*[F.lit(v) for v in vocabulary]).cast("array<string>")
    used = F.filter(terms, lambda v: F.contains(text, v))
    on_url = F.lit(False)
    for t in url_terms:
        on_url = on_url | F.contains(F.lower(url), F.lit(t))
    in_title = F.exists(terms, lambda v: F.contains(title, v))
    both = F.exists(q, lambda t: F.contains(text, t) & F.exists(terms, lambda v: F.contains(v, t)))
    grant = lambda c, x: F.when(F.coalesce(c, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    domain = F.when((F.size(used) > 0) | on_url, F.least(F.lit(0.30), 0.15 + 0.03 * F.size(used) + grant(on_url, 0.10) + grant(in_title, 0.08) + grant(both, 0.15))).otherwise(F.lit(0.0))
    web = 0.15 + grant(nav, 0.12) + grant(topic, 0.25) + grant(topic & named, 0.35) + F.when(page > 1, F.least(F.lit(0.18), 0.06 * page)).otherwise(F.lit(0.0)) + grant(inside, 0.10) + domain
    score = F.when(F.col("source_type") == "website", F.greatest(start - web, F.lit(0.0))).otherwise(start)
    return rows.withColumns({"score": score, "nav": nav}).drop("_q", "_shared")


def placed(hits: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` hits of each query in their order (place from 1): by score, ties by distance rank. If none of
    the first k is a website but the pool has one, the best (with navigation text if any) comes first. Where
    the first three are of one type, the third changes places with the first later one of another."""
    w = Window.partitionBy("query_id")
    rows = hits.withColumn("rn", F.row_number().over(w.orderBy("score", "rank")))
    is_web = F.coalesce(F.col("source_type") == "website", F.lit(False))
    best = F.min(F.when(is_web, F.struct((~F.col("nav")).alias("n"), F.col("rn").alias("rn")))).over(w)["rn"]
    has = F.max((is_web & (F.col("rn") <= k)).cast("int")).over(w) == 1
    rows = rows.withColumns({"_best": best, "_has": has})
    lead = ~F.col("_has") & F.col("_best").isNotNull() & (F.col("rn") == F.col("_best"))
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.when(lead, 0).otherwise(1), "rn"))).filter(F.col("place") <= k)
    kind = lambda n: F.max(F.when(F.col("place") == n, F.coalesce("source_type", F.lit("")))).over(w)
    rows = rows.withColumns({"_1": kind(1), "_2": kind(2), "_3": kind(3)})
    same = (F.col("_1") == F.col("_2")) & (F.col("_2") == F.col("_3"))
    other = F.min(F.when((F.col("place") > 3) & (F.coalesce("source_type", F.lit("")) != F.col("_1")), F.col("place"))).over(w)
    rows = rows.withColumn("_swap", F.when(same, other))
    new = F.when(F.col("_swap").isNull(), F.col("place")).when(F.col("place") == 3, F.col("_swap")).when(F.col("place") == F.col("_swap"), F.lit(3)).otherwise(F.col("place"))
    return rows.withColumn("place", new.cast("int")).drop("rn", "_best", "_has", "_1", "_2", "_3", "_swap")


def hybrid_search(queries: DataFrame, entries: DataFrame, k: int = 5, **terms: tuple[str, ...]) -> DataFrame:
    """Batch search of ``queries`` (query_id, query, vector) over ``entries`` (entry_id, pos, vector, text, title,
    url, source_type, page_number): pool of 5k by distance, re-ranked and placed. Texts join after the pool."""
    pool = block_topk(queries, entries, 5 * k)
    payload = entries.drop("vector", "pos")
    hits = pool.join(payload, "entry_id").join(queries.select("query_id", "query"), "query_id")
    return placed(rerank(hits, **terms), k)


def hit_types(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "source_type").agg(F.count(F.lit(1)).alias("n"))


def context(hits: DataFrame, n: int = 5) -> DataFrame:
    """The text given to an answer: the ``n`` hits of least score (missing: 1.0), numbered from 1."""
    w = Window.partitionBy("query_id").orderBy(F.coalesce("score", F.lit(1.0)), "rank")
    rows = hits.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= n)
    parts = F.array_sort(F.collect_list(F.struct("i", "text")))
    body = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("\nDocument ["), x["i"].cast("string"), F.lit("]:\n"), x["text"], F.lit("\n"))), "")
    return rows.groupBy("query_id").agg(body.alias("context"))


def longest(candidates: Column) -> Column:
    """Of array<struct<method, text>> the one with the longest text, the first of equals."""
    n = F.array_max(F.transform(candidates, lambda c: F.length(c["text"])))
    return F.get(F.filter(candidates, lambda c: F.length(c["text"]) == n), F.lit(0))
