"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trophos.llm import vector_graph as V

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every=20, k=20):
    """{(query_id, vector): [(vec_id, score)]} over distinct usable rows."""
    rows = {
        (i, tuple(v)) for i, v in rows
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    }
    out = {}
    for i, v in rows:
        if i % every == 0:
            others = [(-float(np.dot(v, w)), j) for j, w in rows if j != i and len(w) == len(v)]
            out.setdefault(i, []).append([(j, -s) for s, j in sorted(others)[:k]])
    return out


def found(frame, **options):
    rows = V.nearest_neighbours(frame, **options).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ranks = {(r["query_id"], r["rank"]) for r in rows}
    return out, ranks


def clustered(seed, n, clusters=6, width=16, noise=0.3):
    pick = np.random.default_rng(seed)
    middle = pick.normal(size=(clusters, width))
    x = middle[pick.integers(clusters, size=n)] + noise * pick.normal(size=(n, width))
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]


def recall(got, true):
    hits = [len({j for j, _ in got.get(q, [])} & {j for j, _ in lists[0]}) / max(1, len(lists[0])) for q, lists in true.items()]
    return np.mean(hits)


def test_given_table(spark, folder):
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got, ranks = found(frame)
    true = brute(rows)
    assert got.keys() == true.keys() and recall(got, true) > 0.97
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, own in got.items():
        assert len(own) == 20 and {(q, r) for r in range(1, 21)} <= ranks
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))
        assert all(abs(s - vectors[q] @ vectors[j]) < 1e-12 and j != q for j, s in own)


def test_many_shards_of_unequal_lengths(spark):
    """Norms differ tenfold, cells are split, and queries visit some cells only."""
    scale = np.random.default_rng(3).uniform(0.3, 3, 4_000)
    rows = [(i, [c * s for c in v]) for (i, v), s in zip(clustered(1, 4_000), scale.astype(np.float32).tolist())]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got, _ = found(frame, shard_rows=400)
    assert recall(got, brute(rows)) > 0.95


def test_one_vector_is_a_third_of_all(spark):
    rows = [(i, (np.array(v) / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in clustered(2, 900)]
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    got, _ = found(spark.createDataFrame(rows, SCHEMA))
    true = brute([(r["vec_id"], r["embedding"]) for r in spark.createDataFrame(rows, SCHEMA).collect()])
    assert recall(got, true) > 0.97
    copies = [q for q in got if q % 3 == 0]
    assert copies and all([j for j, _ in got[q]] == [j for j in range(0, 66, 3) if j != q][:20] for q in copies)


def test_near_copies(spark):
    """A group of vectors that are nearer to each other than any graph of the others would show."""
    pick = np.random.default_rng(8)
    rows = clustered(4, 600)
    one = np.array(rows[0][1])
    rows += [(600 + i, (one + 1e-3 * pick.normal(size=16)).astype(np.float32).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got, _ = found(frame)
    assert recall(got, brute([(r["vec_id"], r["embedding"]) for r in frame.collect()])) > 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [-0.0, -1.0]), (3, None),
        (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [1.0, inf]), (4, [None, 1.0]), (None, [1.0, 1.0]), (100, []), (5, [2.0, 2.0]),
        (120, [1.0, 2.0, 3.0]), (6, [1.0, 0.0, 0.0]), (140, [7.0]), (-20, [0.0, -2.0]), (7, [0.0, -1.0]),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    clashing = ("node", "vector", "ids", "shard", "cell", "rank", "score", "place", "edges")
    frame = frame.select("*", *[F.lit("z").alias(c) for c in clashing]).repartition(3)
    got, _ = found(frame)
    true = brute(rows)
    assert got.keys() == {q for q, lists in true.items() if lists[0]}
    for q, lists in true.items():
        assert sorted(p for own in lists for p in own) == sorted(got.get(q, []))
    assert V.nearest_neighbours(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 33, 700])
def test_graph_reaches_every_node(n):
    x = V.with_one_length(np.random.default_rng(n).normal(size=(n, 8)))
    edges, entry = V.build_graph(x, degree=16, beam=32)
    assert edges.shape == (n, 16) and not (edges == np.arange(n)[:, None]).any()
    seen, front = {entry}, [entry]
    while front:
        front = [j for i in front for j in edges[i].tolist() if j < n and j not in seen and not seen.add(j)]
    assert len(seen) >= 0.99 * n
    ids, far, _ = V.greedy_search(x, edges, x, entry, 32)
    assert (np.diff(far[np.isfinite(far).all(axis=1)], axis=1) >= 0).all()
    assert (ids[:, 0] == np.arange(n)).mean() > 0.98
