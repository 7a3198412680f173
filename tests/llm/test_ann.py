from fractions import Fraction

import numpy as np
import pytest

from seqloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, list string, id int"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "l", 2) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def exact(vectors, query_ids, k):
    ids = sorted({i for i, _ in vectors})
    x = np.stack([dict(vectors)[i] for i in ids]).astype(np.float32).astype(float)
    out = {}
    for q in query_ids:
        score = (x * x[ids.index(q)]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(ids[j], score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("kind", ["random", "clustered", "lengths", "hot"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "LIST", 60)
    monkeypatch.setattr(ann, "VECTORS", 100)  # many blocks of a list
    monkeypatch.setattr(ann, "QUERIES", 20)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    if kind == "clustered":
        x = x * 0.1 + rng.normal(size=(20, 16))[rng.integers(0, 20, len(x))]
    if kind == "lengths":
        x *= rng.uniform(0.2, 3, (len(x), 1))
    if kind == "hot":
        x[::3] = x[0]
    vectors = list(enumerate(x))
    df = table(spark, vectors)
    got = found(ann.nearest(df, df.where("vec_id % 20 = 0"), 20))
    want = exact(vectors, range(0, 1500, 20), 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    scores = {q: dict(exact(vectors, [q], 1500)[q]) for q in list(want)[:5]}
    for q, near in scores.items():
        assert all(abs(near[i] - s) < 1e-9 for i, s in got[q])
    if kind == "hot":
        assert got[0] == want[0]  # copies tie and the smaller ids win


def test_recall_holds_where_lists_are_many(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 8)  # a fixed ratio of 1.08 finds 0.22 here
    x = np.random.default_rng(5).normal(size=(12_000, 64))
    x = (x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.float32)
    df = table(spark, list(enumerate(x)))
    got = found(ann.nearest(df, df.where("vec_id % 60 = 0"), 20))
    hits = 0
    for q in range(0, len(x), 60):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hits += len({i for i, _ in got[q]} & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.93 * 20 * 200


def test_odd_vectors_take_no_part(spark):
    good = [(i, [1.0, i / 10, 0.5]) for i in range(6)]
    odd = [(7, None), (8, [0.0, 0.0, 0.0]), (9, [1.0, None, 2.0]), (10, [1.0, float("nan"), 1.0]),
           (11, [float("inf"), 1.0, 1.0]), (12, []), (13, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = table(spark, good + odd + [good[0]])
    got = found(ann.nearest(df, df, 20))
    assert got.keys() == {i for i, _ in good}
    want = exact(good, range(6), 20)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}


def test_empty(spark):
    df = table(spark, [])
    assert ann.nearest(df, df).count() == 0
    df = table(spark, [(1, [1.0, 2.0])])
    assert ann.nearest(df, df).count() == 0  # no candidate but itself


def test_graph_search_is_near_exact():
    rng = np.random.default_rng(3)
    centroids = rng.normal(size=(400, 8))
    graph = ann.Graph.of(centroids)
    x = rng.normal(size=(50, 8))
    ids, dist = graph.search(x, 48)
    best = ((centroids - x[:, None]) ** 2).sum(2).argmin(1)
    assert (ids[:, 0] == best).mean() > 0.95
    assert (np.diff(dist, axis=1) >= 0).all()
    assert all(len(set(row)) == len(row) for row in ids.tolist())


def test_huge_and_tiny_components(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 20)
    x = np.random.default_rng(6).normal(size=(300, 8))
    for odd, at in ((1e200, (3,)), (1e-200, (3, 40, 77)), (1e200, (3, 5, 9))):
        y = x.copy()
        y[list(at)] *= odd
        rows = [(i, v.tolist()) for i, v in enumerate(y)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = found(ann.nearest(df, df.where("vec_id % 3 = 0"), 10))
        assert set(got) == set(range(0, 300, 3))
        hits = 0
        for q, near in got.items():
            score = {i: dot(y[i], y[q]) for i in range(300) if i != q}
            best = sorted(score, key=lambda i: (-score[i], i))[:10]
            hits += len({i for i, _ in near} & set(best))
            assert all(s == pytest.approx(score[i], rel=1e-9, abs=1e-12) for i, s in near)
        assert hits >= 0.95 * 10 * len(got)


def dot(a, b):
    """The inner product by exact fractions; infinite beyond the doubles."""
    exact_sum = sum(Fraction(float(x)) * Fraction(float(y)) for x, y in zip(a, b))
    try:
        return float(exact_sum)
    except OverflowError:
        return float("inf") if exact_sum > 0 else float("-inf")


@pytest.mark.parametrize("dense", [1, 4, 1000])
def test_lists_within_a_ratio(monkeypatch, dense):
    monkeypatch.setattr(ann, "DENSE", dense)
    rng = np.random.default_rng(8)
    graph = ann.Graph.of(rng.normal(size=(150, 6)))
    x = rng.normal(size=(40, 6))
    asked = []
    search = ann.Graph.search
    monkeypatch.setattr(ann.Graph, "search", lambda self, x, beam: asked.append(beam) or search(self, x, beam))
    for ratio in (1.0, 1.3, 3.0):
        ids, near = graph.within(x, ratio, 0.0, 16)
        dist = graph.distances(x)
        want = dist <= ratio * dist.min(1, keepdims=True) + 1e-12
        got = [set(i[n].tolist()) for i, n in zip(ids, near)]
        missed = sum(len(set(np.flatnonzero(w).tolist()) - g) for w, g in zip(want, got))
        assert missed <= 0.05 * want.sum()
    assert asked.count(16) == 3  # the graph is searched first


def test_a_wider_search_that_settles_no_query(monkeypatch):
    rng = np.random.default_rng(9)
    graph = ann.Graph.of(rng.normal(size=(300, 16)))  # beams of 16, 32 and 64 before all are measured
    x = rng.normal(size=(30, 16))
    settled = []
    put = ann._set
    monkeypatch.setattr(ann, "_set", lambda ids, near, rows, *more: settled.append(len(rows)) or put(ids, near, rows, *more))
    ids, near = graph.within(x, 3.0, 0.0, 16)
    assert settled == [0, 0, 0, 30]
    dist = graph.distances(x)
    want = dist <= 3.0 * dist.min(1, keepdims=True)
    assert [set(i[n].tolist()) for i, n in zip(ids, near)] == [set(np.flatnonzero(w).tolist()) for w in want]
