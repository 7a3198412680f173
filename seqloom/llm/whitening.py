"""Whitening of embeddings with a covariance from polarisation, in whole numbers.

Components become whole numbers ``x = floor(scale * c) + shift``.  A first job takes the
number of vectors ``n`` and the sums ``S``; a second one the sums of squares of the centred
values ``n * x - S`` of every dimension, and of the sum of every two dimensions.  Since
``(a + b)**2 = a**2 + b**2 + 2 * a * b``, the difference of those variances is twice the
covariance of the pair.  Squares are added in two halves of their digits, so all sums are
exact; tasks reduce their vectors to one row per pair before the exchange, and only the
matrix, whose size is that of the dimensions, is put together for the eigenvectors.

Rows whose vector is null or empty or holds null or non-finite components take no part; nor do
vectors of another width than the most common one (the larger on ties) and those with a
component beyond ``LARGEST``, whose whole number would not fit.  ``deviation`` is null
where it exceeds a long.  Components without variance cannot be whitened and give no rows:
a single vector, or equal ones, give none.  Null and repeated ids are rows of their own,
extra columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import drop_shuffles

LARGEST = 1e9  # of a component that takes part
SCALE, SHIFT = 1024, 100_000
BLOCK = 1024  # vectors whose pair sums are held at once
HALF = 24  # binary digits of the lower half of a centred value
DIGITS = 10**18  # sums of squares travel in two parts
FLAT = 1e-12  # share of the trace below which a component has no variance
SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, vec``: the vectors that take part, in double precision."""
    vec = F.col(vector).cast("array<double>")
    good = F.forall("vec", lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))  # a NaN exceeds every number
    rows = table.select(F.col(key).cast("long").alias("vec_id"), vec.alias("vec")).where(good & (F.size("vec") > 0))
    widths = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1)
    width = widths.first()
    return rows.where(F.size("vec") == (width["width"] if width else 0))


def whole(batch: pa.RecordBatch, scale: float, shift: int) -> np.ndarray:
    """The components as whole numbers, a row per vector."""
    flat = batch["vec"].flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * scale).astype(np.int64).reshape(len(batch), -1) + shift


@dataclass(frozen=True)
class Fit:
    """Centre and components of the fit list."""

    n: int
    floor: np.ndarray  # whole part of the mean
    rest: np.ndarray  # S - n * floor
    vectors: np.ndarray  # a column per component
    values: np.ndarray  # eigenvalues of the covariance, falling
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.floor) - self.rest / self.n) @ self.vectors / np.sqrt(self.values)


def sums(vectors: DataFrame, scale: float, shift: int) -> tuple[int, list[int]]:
    """Number of the vectors and exact sum of every dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, 0
        for batch in batches:
            n, s = n + len(batch), s + whole(batch, scale, shift).astype(object).sum(0)
        if n:
            columns = [pa.array(range(len(s)), pa.int32()), pa.array([n] * len(s)), pa.array(list(s), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "s"])

    parts = vectors.select("vec").mapInArrow(add, "i int, n long, s decimal(38,0)")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()  # a row per dimension
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def squares(vectors: DataFrame, n: int, floor: np.ndarray, rest: np.ndarray, scale: float, shift: int) -> dict:
    """Exact sum of ``(d_i + d_j)**2`` for every pair, of ``d_i**2`` where ``i = j``; ``d`` is centred."""
    dims = len(floor)
    first, second = np.triu_indices(dims)
    single = first == second

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(first), object) for _ in range(3)]
        for batch in batches:
            x = whole(batch, scale, shift)
            for at in range(0, len(x), BLOCK):
                d = centred(x[at : at + BLOCK], n, floor, rest)
                e = np.where(single, d[:, first], d[:, first] + d[:, second])
                high, low = e >> HALF, e & ((1 << HALF) - 1)
                for t, (a, b) in zip(total, ((high, high), (high, low), (low, low))):
                    t += _exact(a, b)
        square = (total[0] << 2 * HALF) + (total[1] << HALF + 1) + total[2]
        digits = [pa.array(list(part), pa.decimal128(38, 0)) for part in (square // DIGITS, square % DIGITS)]
        columns = [pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), *digits]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "upper", "lower"])

    parts = vectors.select("vec").mapInArrow(add, "i int, j int, upper decimal(38,0), lower decimal(38,0)")
    rows = parts.groupBy("i", "j").agg(F.sum("upper").alias("upper"), F.sum("lower").alias("lower")).collect()  # a row per pair
    return {(r["i"], r["j"]): int(r["upper"]) * DIGITS + int(r["lower"]) for r in rows}


def centred(x: np.ndarray, n: int, floor: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``n * x - S``, in Python's whole numbers where a long could overflow."""
    y = x - floor
    if n * (int(np.abs(y).max(initial=0)) + 1) >= 1 << 61:
        y = y.astype(object)
    return n * y - rest


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Column sums of products, in Python's whole numbers where a long could overflow."""
    if a.dtype != object and int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * len(a) < 1 << 62:
        return np.einsum("ij,ij->j", a, b).astype(object)
    return (a.astype(object) * b.astype(object)).sum(0)


def covariance(square: dict, n: int, dims: int) -> np.ndarray:
    """The covariance in double precision from differences of exact variances."""
    v = np.empty((dims, dims))
    for (i, j), q in square.items():
        twice = 2 * q if i == j else q - square[i, i] - square[j, j]
        v[i, j] = v[j, i] = float(Fraction(twice, 2 * n**3))
    return v


def fit(vectors: DataFrame, components: int = 8, scale: float = SCALE, shift: int = SHIFT) -> Fit | None:
    """The components of ``vec`` columns of one width; none for an empty table."""
    n, s = sums(vectors, scale, shift)
    if not n:
        return None
    floor = np.array([v // n for v in s], np.int64)
    rest = np.array([v % n for v in s], np.int64)
    v = covariance(squares(vectors, n, floor, rest, scale, shift), n, len(s))
    values, basis = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > FLAT * np.trace(v)]
    return Fit(n, floor, rest, basis[:, order], values[order], float(np.trace(v)))


def identity_error(vectors: DataFrame, model: Fit, scale: float = SCALE, shift: int = SHIFT) -> float:
    """Largest entry by which the covariance of the whitened vectors departs from the identity."""
    k = len(model.values)
    first, second = np.triu_indices(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + len(first))
        for batch in batches:
            w = model.whitened(whole(batch, scale, shift))
            total += np.r_[w.sum(0), np.einsum("ij,ij->j", w[:, first], w[:, second])]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    rows = vectors.select("vec").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    means = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])]) / model.n
    return float(np.abs(means[k:] - means[first] * means[second] - (first == second)).max())


def whiten(table: DataFrame, components: int = 8, scale: float = SCALE, shift: int = SHIFT, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector and component: ``n, deviation, whitened, explained, identity_error``."""
    drop_shuffles(table.sparkSession)
    vectors = usable(table, key, vector)
    model = fit(vectors, components, scale, shift)
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], SCHEMA)
    error, k = identity_error(vectors, model, scale, shift), len(model.values)
    explained = model.values / model.trace

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = whole(batch, scale, shift), len(batch)
            columns = [
                batch["vec_id"].take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n)),
                pa.array(deviations(x, model)).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return vectors.mapInArrow(place, SCHEMA)


def deviations(x: np.ndarray, model: Fit) -> pa.Array:
    """Sum over the dimensions of the squared centred values; null where it exceeds a long."""
    d = centred(x, model.n, model.floor, model.rest)
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 62:
        return pa.array(np.einsum("ij,ij->i", d, d))
    exact = (d.astype(object) ** 2).sum(1)
    return pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())
