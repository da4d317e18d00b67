"""Recall of the graph at the production shard size against brute force, and copies beyond the index's members."""

import numpy as np
import pytest

from weftbase.llm import neighbours


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clusters(count, members, noise, dim=64):
    rng = np.random.default_rng(count)
    return unit(np.repeat(unit(rng.normal(size=(count, dim))), members, 0) + noise * rng.normal(size=(count * members, dim)))


def recall(x, queries, found):
    """Share of the five nearest of each query that were found; as near as the fifth counts."""
    near = x[queries] @ x.T
    near[np.arange(len(queries)), queries] = -9
    fifth = np.sort(near, 1)[:, -5]
    hits = [sum(near[i, j] >= fifth[i] - 1e-7 for j in own if j >= 0 and j != queries[i]) for i, own in enumerate(found)]
    return sum(min(h, 5) for h in hits) / (5 * len(queries))


@pytest.mark.parametrize("case", [(60, 100, 0.02), (60, 100, 0.2), (6, 1000, 0.005), (200, 30, 0.02), (6000, 1, 1.0), (6000, 1, 1.0, 256)])
def test_recall_of_a_full_shard(case):
    x = clusters(*case).astype(np.float32)
    graph, entries = neighbours.build_graph(x)
    queries = np.arange(0, len(x), 25)
    found = neighbours.settled_search(x, graph, entries, x[queries], 96, 6)
    assert recall(x.astype(np.float64), queries, found) >= 0.95


def test_recall_over_three_full_shards(spark):
    x = clusters(150, 100, 0.02, 32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = neighbours.build_index(vectors)
    assert index.count() == 3
    rows = neighbours.search(index, vectors.filter("vec_id % 50 = 0")).collect()
    queries = np.arange(0, len(x), 50)
    found = {q: [] for q in queries.tolist()}
    for r in rows:
        found[r["query_id"]].append(r["vec_id"])
        assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-12
    assert all(len(f) == 5 for f in found.values())
    assert recall(x, queries, [found[q] for q in queries.tolist()]) >= 0.95


def test_more_neighbours_than_usual(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(50, [0.9, 0.1])], "vec_id long, embedding array<double>")
    one = vectors.filter("vec_id = 50")
    with pytest.raises(ValueError, match="members=9"):
        neighbours.search(neighbours.build_index(vectors), one, k=8)
    for query, want in ((one, list(range(8))), (vectors.filter("vec_id = 3"), [0, 1, 2, 4, 5, 6, 7, 8])):
        got = neighbours.search(neighbours.build_index(vectors, members=9), query, k=8).collect()
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == want


def test_repeated_rows(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"]) for r in neighbours.search(neighbours.build_index(vectors), vectors.filter("vec_id = 0")).collect())
    assert got == [(1, 1), (2, 1), (3, 2)]
