"""Distances between feature vectors, as Spark columns and as Arrow-task helpers.

The column forms stay inside the JVM (higher-order functions on ``ARRAY<DOUBLE>``);
the NumPy forms serve the link construction, which compares one frame with a handful
of earlier ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _zip_sum(a, b, fn):
    return F.aggregate(F.zip_with(a, b, fn), F.lit(0.0), lambda s, v: s + v)


def _sum(a, fn=lambda v: v):
    return F.aggregate(F.transform(a, fn), F.lit(0.0), lambda s, v: s + v)


def sqeuclidean(a, b) -> Column:
    return _zip_sum(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a, b) -> Column:
    return F.sqrt(sqeuclidean(a, b))


def cityblock(a, b) -> Column:
    return _zip_sum(a, b, lambda x, y: F.abs(x - y))


def chebyshev(a, b) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a, b) -> Column:
    norms = F.sqrt(_sum(a, lambda v: v * v)) * F.sqrt(_sum(b, lambda v: v * v))
    return F.lit(1.0) - F.try_divide(_zip_sum(a, b, lambda x, y: x * y), norms)


def correlation(a, b) -> Column:
    def centred(v):
        mean = _sum(v) / F.size(v)
        return F.transform(v, lambda x: x - mean)

    return cosine(centred(a), centred(b))


def canberra(a, b) -> Column:
    return _zip_sum(
        a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))
    )


def braycurtis(a, b) -> Column:
    return F.try_divide(
        _zip_sum(a, b, lambda x, y: F.abs(x - y)), _zip_sum(a, b, lambda x, y: F.abs(x + y))
    )


def hamming(a, b) -> Column:
    return _zip_sum(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)) / F.size(a)


METRICS = {
    f.__name__: f
    for f in (
        sqeuclidean, euclidean, cityblock, chebyshev, cosine,
        correlation, canberra, braycurtis, hamming,
    )
}


def distance(a, b, metric="euclidean") -> Column:
    """Distance between two ``ARRAY<DOUBLE>`` columns; ``metric`` names one or is a callable."""
    if callable(metric):
        return metric(a, b)
    if metric == "tonnetz":
        return tonnetz(a, b)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(METRICS)} and 'tonnetz'")
    return METRICS[metric](a, b)


# Pitch-class circles of fifths, minor and major thirds (radius, angle step).
TONNETZ_CIRCLES = ((1.0, 7 * math.pi / 6), (1.0, 3 * math.pi / 2), (0.5, 2 * math.pi / 3))


def tonnetz_point(chroma) -> Column:
    """A 12-bin chroma projected on the three circles and scaled to unit L1 norm."""
    axes = []
    for radius, angle in TONNETZ_CIRCLES:
        for wave in (math.sin, math.cos):
            weights = F.array(*[F.lit(radius * wave(angle * p)) for p in range(12)])
            axes.append(_zip_sum(chroma, weights, lambda x, w: x * w))
    raw = F.array(*axes)
    total = _sum(raw, F.abs)
    empty = _sum(chroma, F.abs) == 0
    return F.transform(raw, lambda v: F.when(empty, 0.0).otherwise(F.try_divide(v, total)))


def tonnetz(a, b) -> Column:
    return euclidean(tonnetz_point(a), tonnetz_point(b))


def rotations(a, shift: int = 1, step: int | None = None) -> Column:
    """The vector and its circular shifts by ``shift, -shift, 2*shift ...``; all when no step."""
    size = F.size(a)

    def roll(by):
        cut = F.pmod(-by, size)
        return F.concat(F.slice(a, cut + 1, size - cut), F.slice(a, F.lit(1), cut))

    if step is None:
        return F.transform(F.sequence(F.lit(0), size - 1), roll)
    offsets = [0] + [k * shift for k in range(1, step + 1)] + [-k * shift for k in range(1, step + 1)]
    return F.array(*[roll(F.lit(k)) for k in offsets])


def transposed_distance(a, b, shift: int = 1, step: int | None = None) -> Column:
    """Smallest Euclidean distance between ``b`` and any rotation of ``a``."""
    return F.array_min(F.transform(rotations(a, shift, step), lambda r: euclidean(r, b)))


# -- helpers used inside Arrow tasks -------------------------------------------------


def _np_unit(x):
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _np_ratio(top, bottom):
    with np.errstate(invalid="ignore", divide="ignore"):
        return top / bottom


def _np_canberra(p, q):
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nansum(np.abs(p - q) / (np.abs(p) + np.abs(q)), axis=1)


_PAIRWISE = {
    "sqeuclidean": lambda p, q: ((p - q) ** 2).sum(axis=1),
    "euclidean": lambda p, q: np.sqrt(((p - q) ** 2).sum(axis=1)),
    "cityblock": lambda p, q: np.abs(p - q).sum(axis=1),
    "chebyshev": lambda p, q: np.abs(p - q).max(axis=1),
    "cosine": lambda p, q: 1.0 - (p * q).sum(axis=1),
    "correlation": lambda p, q: 1.0 - (p * q).sum(axis=1),
    "canberra": _np_canberra,
    "braycurtis": lambda p, q: _np_ratio(np.abs(p - q).sum(axis=1), np.abs(p + q).sum(axis=1)),
    "hamming": lambda p, q: (p != q).mean(axis=1),
    "tonnetz": lambda p, q: np.sqrt(((p - q) ** 2).sum(axis=1)),
}


def row_metric(metric, x: np.ndarray):
    """``f(i, rows)``: distances from row ``i`` of ``x`` to the given rows.

    A callable metric receives the frame and a matrix of other frames.
    """
    if callable(metric):
        return lambda i, rows: np.asarray(metric(x[i], x[rows]), dtype=float)
    x, pair = _prepared(metric, x), _PAIRWISE[metric]
    return lambda i, rows: pair(x[i], x[rows])


def rough_metric(metric, x: np.ndarray):
    """Frames ``r`` and a margin: ``1 - r[rows] @ r[i]`` is the distance but for the margin.

    Single precision and a plain product, so many rows are told apart at little cost.  Only for angles, else none.
    """
    if callable(metric) or metric not in ("cosine", "correlation"):
        return None
    return _prepared(metric, x).astype(np.float32), 4.0 * np.finfo(np.float32).eps * (x.shape[1] + 8)


def _prepared(metric, x: np.ndarray) -> np.ndarray:
    if metric not in _PAIRWISE:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(_PAIRWISE)}")
    if metric == "correlation":
        x = x - x.mean(axis=1, keepdims=True)
    if metric in ("cosine", "correlation"):
        x = _np_unit(x)
    return _np_tonnetz(x) if metric == "tonnetz" else x


def measuring(metric):
    """``prepare(frame)`` and ``measure(frame, frames)`` on prepared ones, with the arithmetic of ``row_metric``."""
    if callable(metric):
        return np.asarray, lambda p, rows: np.asarray(metric(p, rows), dtype=float)
    return lambda x: _prepared(metric, np.asarray(x, dtype=float)[None])[0], _PAIRWISE[metric]


def as_length(metric):
    """The increasing function that makes a distance obey the triangle inequality; none if unknown."""
    if callable(metric):
        return None
    if metric in ("cosine", "correlation"):  # half the squared chord between unit vectors
        return lambda d: np.sqrt(2 * np.maximum(d, 0.0))
    if metric == "sqeuclidean":
        return np.sqrt
    if metric in ("euclidean", "cityblock", "chebyshev", "hamming", "tonnetz"):
        return np.asarray
    return None


def pair_distance(metric):
    """Distance of two frame columns, row by row, with the arithmetic of ``row_metric``."""

    @F.arrow_udf(T.DoubleType())
    def pairs(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in (a, b))
        if not len(x):
            return pa.array([], pa.float64())
        if callable(metric):
            return pa.array([float(np.asarray(metric(p, q[None]), dtype=float)[0]) for p, q in zip(x, y)], pa.float64())
        return pa.array(_PAIRWISE[metric](_prepared(metric, x), _prepared(metric, y)), pa.float64())

    return pairs


def _np_tonnetz(x):
    pitch = np.arange(12)
    axes = np.array([r * f(a * pitch) for r, a in TONNETZ_CIRCLES for f in (np.sin, np.cos)])
    raw = x @ axes.T
    total = np.abs(raw).sum(axis=1, keepdims=True)
    return np.where(np.abs(x).sum(axis=1, keepdims=True) == 0, 0.0, _np_ratio(raw, total))
