"""Whitening against whole-number covariances written out in plain Python."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component int, deviation string"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3, "x") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def exact(x):
    """Deviations and covariance of whole-number rows, as fractions."""
    n, dims = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(dims)]
    d = [[n * r[k] - s[k] for k in range(dims)] for r in x]
    v = [[Fraction(sum(r[a] * r[b] for r in d), n**3) for b in range(dims)] for a in range(dims)]
    return [sum(c * c for c in r) for r in d], v, d


@pytest.mark.parametrize("seed,n,dims", [(1, 300, 12), (2, 9, 8), (3, 40, 3)])
def test_against_exact_covariance(spark, seed, n, dims):
    r = np.random.default_rng(seed)
    c = (r.normal(size=(n, dims)) * np.geomspace(1, 0.05, dims) + r.normal(size=dims)).astype(np.float32)
    got = whitening.whiten(table(spark, enumerate(c.tolist())).repartition(3)).collect()
    x = [[int(np.floor(1024 * float(v))) + 100_000 for v in row] for row in c]
    deviation, v, d = exact(x)
    values, basis = np.linalg.eigh(np.array(v, dtype=float))
    values, basis = values[::-1], basis[:, ::-1]
    k = min(8, dims)
    assert len(got) == n * k and {g.component for g in got} == set(range(1, k + 1))
    white = np.zeros((n, k))
    for g in got:
        assert g.n == n and g.deviation == deviation[g.vec_id]
        assert abs(g.explained - values[g.component - 1] / values.sum()) < 1e-9
        assert g.identity_error <= 1e-4
        white[g.vec_id, g.component - 1] = g.whitened
    want = np.array(d, dtype=float) / n @ basis[:, :k] / np.sqrt(values[:k])
    signs = np.sign((white * want).sum(0))
    assert np.allclose(white, want * signs, atol=1e-6)


def test_rows_that_take_no_part(spark):
    good = [(1, [0.5, -1]), (2, [0.25, 2]), (None, [1, 0]), (2, [0.25, 2]), (5, [-3, 1])]
    bad = [(7, None), (8, [None, 1]), (9, [float("nan"), 1]), (10, [float("inf"), 1]), (11, []), (12, [1, 2, 3]), (13, [1e30, 1])]
    got = whitening.whiten(table(spark, good + bad)).collect()
    assert len(got) == 10 and {g.n for g in got} == {5}
    assert sorted((g.vec_id or 0) for g in got) == [0, 0, 1, 1, 2, 2, 2, 2, 5, 5]


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1, 2])])).collect() == []
    assert whitening.whiten(table(spark, [(i, [0.1, 0.2]) for i in range(30)])).collect() == []
    line = whitening.whiten(table(spark, [(i, [i, 2 * i, 5]) for i in range(10)])).collect()
    assert {g.component for g in line} == {1} and all(abs(g.explained - 1) < 1e-12 for g in line)


def test_sums_beyond_a_long_are_exact(spark):
    r = np.random.default_rng(4)
    c = r.integers(-(10**8), 10**8, (50, 3)).astype(float)
    vectors = whitening.usable(table(spark, enumerate(c.tolist())), "vec_id", "embedding")
    n, s = whitening.sums(vectors, 1024, 100_000)
    x = [[int(np.floor(1024 * float(np.float32(v)))) + 100_000 for v in row] for row in c]
    assert (n, s) == (50, [sum(col) for col in zip(*x)])
    floor, rest = np.array([v // n for v in s]), np.array([v % n for v in s])
    q = whitening.squares(vectors, n, floor, rest, 1024, 100_000)
    d = exact(x)[2]
    assert q == {(i, j): sum((r[i] + (r[j] if i < j else 0)) ** 2 for r in d) for i in range(3) for j in range(i, 3)}


def test_deviation_beyond_a_long_is_null():
    model = whitening.Fit(2, np.array([0]), np.array([0]), np.eye(1), np.ones(1), 1.0)
    assert whitening.deviations(np.array([[3], [2**40]]), model).to_pylist() == [36, None]
    assert whitening.deviations(np.array([[3]]), model) == pa.array([36])
