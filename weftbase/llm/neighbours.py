"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard.

Equal vectors are one node. Nodes are dealt to shards of bounded size by a hash. Within a shard, points
enter a graph in batches: a greedy beam search proposes neighbours, and robust pruning keeps the nearest while
it drops those that a kept one covers (``alpha`` times nearer to it than to the point). Searches begin at the
nearest of many entry points that lie far apart, since edges seldom lead out of a tight cluster. A query runs a
beam search in every shard, with beams that widen until they find nothing nearer; what the shards find is ranked
by the exact cosine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftbase.llm.scratch import keep

SHARD_ROWS = 6000
#: Entry points that a beam starts from.
STARTS = 16
#: Queries that advance together.
TOGETHER = 1024
INDEX = "shard int, n int, dim int, kept int, entries binary, members binary, vectors binary, graph binary"


def entry_points(x: np.ndarray) -> np.ndarray:
    """About 2 sqrt(n) points, each the farthest from those before it: every cluster that is not among the smallest
    has one. The first is the nearest to the mean."""
    chosen = [int((x @ x.mean(0)).argmax())]
    near = x @ x[chosen[0]]
    for _ in range(min(len(x), int(np.ceil(2 * np.sqrt(len(x))))) - 1):
        chosen.append(int(near.argmin()))
        np.maximum(near, x @ x[chosen[-1]], out=near)
    return np.unique(np.array(chosen, np.int32))


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beams of all queries at once: node ids (-1: none) and squared distances, nearest first. Every query starts
    from the nearest of the entry points. ``x``, ``q``: unit vectors."""
    m, degree = len(q), graph.shape[1]
    ids = np.full((m, width), -1, np.int32)
    dist = np.full((m, width), np.inf, np.float32)
    done = np.ones((m, width), bool)
    first = 2 - 2 * (q @ x[entries].T)
    some = min(STARTS, width, len(entries))
    nearest = np.argsort(first, 1, kind="stable")[:, :some]
    ids[:, :some], dist[:, :some], done[:, :some] = entries[nearest], np.take_along_axis(first, nearest, 1), False
    live = np.arange(m)
    while len(live):
        at = (~done[live]).argmax(1)
        done[live, at] = True
        new = graph[ids[live, at]]
        far = 2 - 2 * np.einsum("mrd,md->mr", x[new], q[live], optimize=True)
        far[(new < 0) | (new[:, :, None] == ids[live][:, None, :]).any(2)] = np.inf
        both_ids = np.concatenate([ids[live], new], 1)
        both_dist = np.concatenate([dist[live], far.astype(np.float32)], 1)
        both_done = np.concatenate([done[live], np.zeros((len(live), degree), bool)], 1)
        order = np.argsort(both_dist, 1, kind="stable")[:, :width]
        rows = np.arange(len(live))[:, None]
        ids[live], dist[live] = both_ids[rows, order], both_dist[rows, order]
        done[live] = both_done[rows, order] | np.isinf(dist[live])
        ids[live] = np.where(np.isinf(dist[live]), -1, ids[live])
        live = live[(~done[live]).any(1)]
    return ids, dist


def settled_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int, k: int) -> np.ndarray:
    """The ``k`` nearest nodes that a beam finds which is doubled, for each query, until it finds no nearer ones."""
    width = min(max(width, k), len(x))
    ids, dist = beam_search(x, graph, entries, q, width)
    best = np.full((len(q), k), -1, np.int32)
    best[:, : min(k, width)] = ids[:, :k]
    reach = dist[:, :k].sum(1)
    live = np.arange(len(q))
    while len(live) and width < len(x):
        width = min(2 * width, len(x))
        ids, dist = beam_search(x, graph, entries, q[live], width)
        nearer = dist[:, :k].sum(1) < reach[live] - 1e-6
        best[live[nearer], : min(k, width)] = ids[nearer, :k]
        reach[live[nearer]] = dist[nearer, :k].sum(1)
        live = live[nearer]
    return best


def robust_prune(x: np.ndarray, points: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges of each point chosen among its candidates ``near`` (rows of ids, -1: none)."""
    near = np.sort(near, 1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[near == points[:, None]] = -1
    own = x[near]
    dist = 2 - 2 * np.einsum("mkd,md->mk", own, x[points], optimize=True)
    dist[near < 0] = np.inf
    order = np.argsort(dist, 1, kind="stable")
    rows = np.arange(len(points))
    near, dist, own = near[rows[:, None], order], dist[rows[:, None], order], own[rows[:, None], order]
    apart = 2 - 2 * (own @ own.transpose(0, 2, 1))
    live = ~np.isinf(dist)
    out = np.full((len(points), degree), -1, np.int32)
    for k in range(degree):
        some = live.any(1)
        if not some.any():
            break
        pick = live.argmax(1)
        out[some, k] = near[rows, pick][some]
        live &= ~(alpha * alpha * apart[rows, pick] <= dist)
        live[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = 24, width: int = 48, alpha: float = 1.2, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """A directed graph over unit vectors, and its entry points."""
    n = len(x)
    degree = min(degree, max(n - 1, 1))
    random = np.random.default_rng(seed)
    entries = entry_points(x)
    graph = np.full((n, degree), -1, np.int32)
    if n == 1:
        return graph, entries
    order = random.permutation(n)
    order = np.concatenate([entries, order[~np.isin(order, entries)]])
    sweeps = [(1, 1.0 if n > 512 else alpha), (0, alpha)]
    for begin, slack in sweeps:
        at = begin
        while at < n:
            size = min(512, n - at, max(1, at) if begin else 512)
            batch = order[at : at + size]
            at += size
            found, _ = beam_search(x, graph, entries if begin == 0 else entries[np.isin(entries, order[: at - size])], x[batch], width)
            new = robust_prune(x, batch, np.concatenate([found, graph[batch]], 1), degree, slack)
            graph[batch] = new
            source, target = np.repeat(batch, degree)[new.ravel() >= 0], new[new >= 0]
            _add_edges(x, graph, source, target, degree, slack)
    return graph, entries


def _add_edges(x: np.ndarray, graph: np.ndarray, source: np.ndarray, target: np.ndarray, degree: int, alpha: float) -> None:
    """Edges back from each new neighbour; a point with too many is pruned."""
    dist = 2 - 2 * np.einsum("kd,kd->k", x[source], x[target])
    order = np.lexsort((dist, target))
    source, target = source[order], target[order]
    points, first, count = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(first, count)
    extra = np.full((len(points), min(int(count.max()), 2 * degree)), -1, np.int32)
    use = rank < extra.shape[1]
    extra[np.repeat(np.arange(len(points)), count)[use], rank[use]] = source[use]
    both = np.concatenate([graph[points], extra], 1)
    room = np.sort(np.where(both < 0, np.iinfo(np.int32).max, both), 1)
    distinct = (room[:, :1] != np.iinfo(np.int32).max).sum(1) + ((room[:, 1:] != room[:, :-1]) & (room[:, 1:] != np.iinfo(np.int32).max)).sum(1)
    fits = distinct <= degree
    if fits.any():
        own = room[fits]
        own[:, 1:][own[:, 1:] == own[:, :-1]] = np.iinfo(np.int32).max
        own = np.sort(own, 1)[:, :degree]
        graph[points[fits]] = np.where(own == np.iinfo(np.int32).max, -1, own)
    if (~fits).any():
        graph[points[~fits]] = robust_prune(x, points[~fits], both[~fits], degree, alpha)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that can take part: no null, not finite or all-zero vector, and the length
    that most vectors have."""
    e = F.col("embedding")
    sound = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & sound).select("vec_id", e.cast("array<double>").alias("embedding"))
    usual = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    return rows.filter(F.size("embedding") == (usual["dim"] if usual else 0))


def _group_keys(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(batch["embedding"].tolist(), np.float64)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def build_index(vectors: DataFrame, members: int = 6, shard_rows: int = SHARD_ROWS, degree: int = 24, width: int = 48, alpha: float = 1.2) -> DataFrame:
    """One row per shard: nodes, their graph, original vectors, and of each node the ``members`` smallest
    vec_ids that have this vector: one more than a search returns, since a query's own does not count. Written to
    the shared folder. A node is named after its smallest vec_id.

    Every usable row is indexed, also rows that repeat a vec_id. With no usable row the index is empty.
    """
    rows = usable(vectors)
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= members)
    nodes = keep(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x, unit = _group_keys(pdf)
        graph, entries = build_graph(unit.astype(np.float32), degree, width, alpha)
        ids = np.full((len(pdf), members), -1, np.int64)
        for i, own in enumerate(pdf["ids"]):
            ids[i, : len(own)] = own
        return pd.DataFrame([[int(key[0]), len(pdf), x.shape[1], members, entries.tobytes(), ids.tobytes(), x.tobytes(), graph.tobytes()]], columns=[c.split()[0] for c in INDEX.split(", ")])

    dealt = nodes.withColumn("node", F.col("ids")[0]).withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    return keep(dealt.groupBy("shard").applyInPandas(build, INDEX), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int = 5, width: int = 96) -> DataFrame:
    """The ``k`` nearest found to each query (vec_id, embedding) but the rows of its own vec_id: query_id,
    rank, vec_id, score (cosine of the original vectors, double). Ties go to the smaller vec_id. Rows of queries
    that repeat a vec_id count as one, any of them.

    Queries are sent to every shard, one row each, and the index once: a task reads a shard and then its queries
    as they come. The index must hold ``k`` + 1 members of a node, or it is an error.
    """
    shards, kept = index.agg(F.max("shard") + 1, F.min("kept")).head()
    if kept is not None and kept < k + 1:
        raise ValueError(f"the index has {kept} members of each vector: build_index(members={k + 1})")
    asked = keep(usable(queries).dropDuplicates(["vec_id"]), "queries")
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards or 1, 1) - 1))))
    columns = [c.split()[0] for c in INDEX.split(", ")]
    rows = index.select(*columns, F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"))
    rows = rows.union(sent.select("shard", *[F.lit(None).alias(c) for c in columns[1:]], "vec_id", "embedding"))

    def run(batches):
        shard, held = None, None
        for batch in batches:
            table = batch.select(["shard", "vec_id"]).to_pandas()
            heads = np.flatnonzero(table["vec_id"].isna())
            cuts = np.unique(np.concatenate([[0], heads, np.flatnonzero(np.diff(table["shard"])) + 1, [len(table)]]))
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if np.isin(low, heads):
                    shard, held = int(table["shard"][low]), _Shard(batch.slice(low, 1).to_pylist()[0])
                    low += 1
                for at in range(low, high, TOGETHER):
                    if held is None or shard != table["shard"][at]:
                        break
                    part = batch.slice(at, min(TOGETHER, high - at))
                    own = part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                    if len(flat) == len(own) * held.x.shape[1]:
                        yield pa.RecordBatch.from_pandas(held.nearest(own, flat.reshape(len(own), -1), k, width), preserve_index=False)

    dealt = rows.repartition(max(shards or 1, 1), "shard").sortWithinPartitions("shard", F.col("vec_id").isNotNull())
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Shard:
    """The index of one shard."""

    def __init__(self, row: dict) -> None:
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"])
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(row["n"], -1)
        self.ids = np.frombuffer(row["members"], np.int64).reshape(row["n"], -1)
        self.entries = np.frombuffer(row["entries"], np.int32)
        self.norm = np.linalg.norm(self.x, axis=1)
        self.unit = (self.x / self.norm[:, None]).astype(np.float32)

    def nearest(self, own: np.ndarray, q: np.ndarray, k: int, width: int) -> pd.DataFrame:
        """The ``k`` nearest members to each query of its own id, with exact scores. One node more is sought than
        members are wanted, as a query's own may be alone with its vector."""
        length = np.linalg.norm(q, axis=1)
        found = settled_search(self.unit, self.graph, self.entries, (q / length[:, None]).astype(np.float32), width, k + 1)
        exact = np.einsum("mkd,md->mk", self.x[found], q) / (self.norm[found] * length[:, None])
        row, col = np.nonzero(found >= 0)
        member = self.ids[found[row, col]]
        table = pd.DataFrame({"query_id": np.repeat(own[row], member.shape[1]), "vec_id": member.ravel(), "score": np.repeat(exact[row, col], member.shape[1])})
        table = table[(table.vec_id >= 0) & (table.vec_id != table.query_id)].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return table.groupby("query_id").head(k)
