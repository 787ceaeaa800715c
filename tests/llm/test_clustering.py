"""Delta Lloyd against plain Lloyd in whole numbers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from jobloom.llm.clustering import LIMIT, cluster_digest, delta_lloyd, nearest


def plain(vectors: list[tuple], k: int, rounds: int, dims: int, scale: int, seed: int) -> list[tuple]:
    """(id, cluster, distance, cluster inertia, inertia, centroid hash), all distances every round."""
    kept = [(i, [max(-LIMIT, min(LIMIT, math.floor(max(min(x * scale, 2.0**40), -(2.0**40))))) for x in e]) for i, e in vectors if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    digest = lambda i: ("~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    at = [v for _, v in sorted(kept, key=lambda x: (digest(x[0]), x[1]))[:k]]
    cost = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((cost(v, c), j) for j, c in enumerate(at)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(at)):
            mine = [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    inertia = [sum(d for d, o in own if o == j) for j in range(len(at))]
    return [(i, o, d, inertia[o], sum(inertia), hashlib.sha256(",".join(map(str, at[o])).encode()).hexdigest()) for (i, _), (d, o) in zip(kept, own, strict=True)]


def data(seed: int, n: int, dims: int) -> list[tuple]:
    rnd = random.Random(seed)
    hub = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [x + rnd.gauss(0, 0.4) for x in rnd.choice(hub)]) for i in range(n)]
    rows += [rows[0], rows[0], (1, rows[2][1]), (None, rows[3][1])]  # repeated rows and ids, a null id
    rows += [(n + k, [0.5] * dims) for k in range(30)]  # one vector many times
    return [*rows, (900, None), (901, []), (902, [0.0] * (dims + 1)), (903, [math.nan] + [0.0] * (dims - 1)), (904, [math.inf] * dims), (905, [None] + [0.0] * (dims - 1))]


def key(row: tuple) -> tuple:
    return (row[0] is None, row)


@pytest.mark.parametrize(("k", "rounds", "dims", "n"), [(8, 10, 64, 150), (3, 4, 5, 90), (1, 2, 2, 20), (500, 2, 3, 60), (4, 0, 3, 40)])
def test_equals_plain_lloyd(spark, k, rounds, dims, n):
    rows = data(k, n, dims)
    table = spark.createDataFrame([(e, i, "x", 7, 1.5) for i, e in rows], "embedding array<float>, vec_id long, cluster string, distance int, n double").repartition(5)
    exact = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    got = cluster_digest(table, k=k, rounds=rounds, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(exact, k, rounds, dims, 1024, 3), key=key)


def test_huge_components_are_held_and_empty_tables_give_no_rows(spark):
    rows = [(1, [3e38, -3e38]), (2, [1.0, 2.0]), (3, [-3e38, 3e38])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, cluster_digest(table, k=2, dims=2).collect())) == sorted(plain(rows, 2, 10, 2, 1024, 3))
    assert cluster_digest(table.limit(0), k=2, dims=2).collect() == []
    with pytest.raises(ValueError, match="k \\* dims"):
        delta_lloyd(table, k=1 << 20, dims=64)


def test_rounds_end_when_no_centroid_changes(spark):
    table = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(20)], "vec_id string, embedding array<float>")
    found = delta_lloyd(table, k=2, rounds=10, dims=2)
    assert found.compared < 11
    assert {tuple(c) for c in found.centroids} <= {(0, 0), (1024, 0), (512, 0)}


def test_a_round_meets_only_what_it_must():
    """A vector whose centroid stands still keeps its distance, even a wrong one; all others are compared anew."""
    v = np.array([[0], [10], [20]])
    own, best = nearest(v, np.array([0, 1, 1]), np.array([7, 3, 50]), np.array([[0], [11], [19]]), np.array([False, False, True]))
    assert own.tolist() == [0, 1, 2]
    assert best.tolist() == [7, 3, 1]
