"""Clustering around centroids with whole numbers, nearest centroids by Orchard's search.

Components become whole numbers, so distances, sums and new centroids are exact and do not
depend on the order of the rows.  Every centroid keeps the list of the others, nearest
first.  A vector starts at one centroid and walks down that one's list: a centroid that was
measured is marked and not measured again, a closer one (or one as close with a smaller
number) makes the walk jump to the start of its own list, and the walk ends at the first
centroid strictly farther from the current one than twice the vector's distance, since no
later one can be closer or as close.  A block of vectors walks together.  Tasks reduce their
vectors to one row of sums per cluster, so only centroids reach the driver.

Vectors that are null, of another width, or hold null or non-finite components take no part,
nor do those with a component beyond ``LARGEST`` whole units, whose squared distances would
not fit a long.  Fewer vectors than centroids make fewer centroids.  A null id is never chosen
as a centroid before others; repeated ids and vectors are rows of their own.  Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .columns import drop_shuffles

LARGEST = 2**26  # whole units of a component that takes part
BLOCK = 4096  # vectors that walk together


def usable(table: DataFrame, width: int, scale: int, key: str, vector: str) -> DataFrame:
    """``vec_id, vec``: the vectors that take part, in whole units."""
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * scale))
    good = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST / scale))
    rows = table.where((F.size(vector) == width) & good)  # a NaN exceeds every number
    return rows.select(F.col(key).cast("long").alias("vec_id"), scaled.cast("array<int>").alias("vec"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest digests of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "vec").limit(k).collect()
    return np.array([r["vec"] for r in rows], np.int64)


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Orchard:
    """Centroids with their sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = square_distances(centroids[:, None], centroids)
        np.fill_diagonal(apart, -1)  # a centroid heads its own list
        self.lists = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.lists, 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each vector, and how many were measured."""
        n, k = len(x), len(self.centroids)
        at = np.zeros(n, np.int64)
        best = square_distances(x, self.centroids[0])
        marked = np.zeros((n, k), bool)
        marked[:, 0] = True
        step, walking, measured = np.zeros(n, np.int64), np.arange(n), n
        while True:
            walking = walking[step[walking] < k - 1]
            here = at[walking], step[walking]
            walking = walking[self.apart[here] <= 4 * best[walking]]  # squares of twice the distance
            if not len(walking):
                return at, best, measured
            other = self.lists[at[walking], step[walking]]
            step[walking] += 1
            new = ~marked[walking, other]
            who, other = walking[new], other[new]
            marked[who, other] = True
            measured += len(who)
            d = square_distances(x[who], self.centroids[other])
            closer = (d < best[who]) | ((d == best[who]) & (other < at[who]))
            who = who[closer]
            at[who], best[who], step[who] = other[closer], d[closer], 0


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    x = batch["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)
    for at in range(0, len(x), BLOCK):
        yield at, x[at : at + BLOCK]


def totals(vectors: DataFrame, search: Orchard) -> dict[int, tuple[int, list[int]]]:
    """Number and component sums of every cluster's vectors."""
    k, width = search.centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for _, x in _blocks(batch):
                cluster = search.nearest(x)[0]
                n += np.bincount(cluster, minlength=k)
                np.add.at(s, cluster, x)
        own = np.flatnonzero(n)
        dims = np.tile(np.arange(width, dtype=np.int32), len(own))
        columns = [pa.array(np.repeat(own, width).astype(np.int32)), pa.array(dims), pa.array(np.repeat(n[own], width)), pa.array(s[own].ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "i", "n", "s"])

    parts = vectors.select("vec").mapInArrow(add, "cluster int, i int, n long, s long")
    summed = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict = {}
    for r in summed.orderBy("cluster", "i").collect():  # a row per centroid and component
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["s"]))
    return out


def assign(vectors: DataFrame, search: Orchard) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector; the distance is squared."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch):
                cluster, distance, _ = search.nearest(x)
                columns = [batch["vec_id"].slice(at, len(x)), pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(place, "vec_id long, cluster int, distance long")


def clusters(table: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Assigned vectors and the final centroids, in whole units."""
    drop_shuffles(table.sparkSession)
    vectors = cut(usable(table, width, scale, key, vector))
    centroids = starts(vectors, k, seed)
    if not len(centroids):
        return table.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        for c, (n, s) in totals(vectors, Orchard(centroids)).items():
            centroids[c] = [v // n for v in s]
    return assign(vectors, Orchard(centroids)), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assigned vectors with the inertia of their cluster and of all, and their centroid's digest."""
    placed = cut(assigned)
    rows = placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # a row per centroid
    of = {r["cluster"]: r["d"] for r in rows}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.array(*[F.lit(of.get(c, 0)).cast("long") for c in range(len(digests))])
    named = F.array(*[F.lit(d) for d in digests])
    return placed.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(of.values())).cast("long").alias("inertia"),
        F.get(named, F.col("cluster")).alias("centroid_sha256"),
    )
