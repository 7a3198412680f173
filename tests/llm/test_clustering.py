"""Centroid clustering against plain Python, and the search against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from seqloom.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance string, vec string"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "x", "y") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, k, rounds, scale=64):
    rows = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in vectors]
    ranked = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [r[1] for r in ranked[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in rows]

    for _ in range(rounds):
        of = assigned()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(rows, of) if c == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    of = assigned()
    total = sum(d for d, _ in of)
    inertia = {j: sum(d for d, c in of if c == j) for j in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((i, c, d, inertia[c], total, digest[c]) for (i, _), (d, c) in zip(rows, of))


def vectors(seed, n, width, step):
    """Few distinct values, so that distances tie."""
    r = random.Random(seed)
    return [(i, [r.randrange(-3, 4) * step for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("seed,n,width,k,step", [(1, 300, 4, 16, 1 / 64), (2, 200, 64, 16, 0.1), (3, 5, 8, 16, 0.3), (4, 60, 1, 7, 1 / 64), (5, 30, 3, 1, 1)])
def test_against_plain_rounds(spark, seed, n, width, k, step):
    rows = vectors(seed, n, width, step)
    found = clustering.clusters(table(spark, rows).repartition(3), k, 3, width)
    got = sorted(map(tuple, clustering.with_inertia(*found).collect()))
    assert got == brute(rows, k, 3)


def test_search_finds_the_nearest_with_fewer_distances():
    r = np.random.default_rng(6)
    for spread in (1, 1000):
        centroids = r.integers(-200, 200, (24, 3)) * spread
        x = centroids[r.integers(0, 24, 3000)] + r.integers(-20, 20, (3000, 3))
        at, d, measured = clustering.Orchard(centroids).nearest(x)
        every = ((x[:, None] - centroids) ** 2).sum(2)
        assert (d == every.min(1)).all() and (at == every.argmin(1)).all()
        assert measured < 0.6 * every.size


def test_equal_centroids_go_to_the_smaller_number():
    centroids = np.array([[5, 5], [0, 0], [0, 0], [5, 5]])
    at, d, _ = clustering.Orchard(centroids).nearest(np.array([[0, 1], [5, 5], [2, 3]]))
    assert at.tolist() == [1, 0, 0] and d.tolist() == [1, 0, 13]


def test_rows_that_take_no_part(spark):
    good = [(i, [i * 0.5, 1]) for i in range(6)] + [(None, [9, 9]), (3, [1.5, 1])]
    bad = [(20, None), (21, [None, 1]), (22, [float("nan"), 1]), (23, [float("-inf"), 1]), (24, []), (25, [1]), (26, [1e30, 0])]
    assigned, centroids = clustering.clusters(table(spark, good + bad), 4, 3, 2)
    assert sorted(r.vec_id or 0 for r in assigned.collect()) == [0, 0, 1, 2, 3, 3, 4, 5]
    assert centroids.shape == (4, 2)
    for rows in ([], [(1, None)]):
        found = clustering.clusters(table(spark, rows), 4, 3, 2)
        assert clustering.with_inertia(*found).collect() == []
