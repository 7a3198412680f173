import numpy as np
import pytest

from seqloom.operators import links, rate
from seqloom.operators.automaton import build_index, build_sweep


def frames(spark, n=60):
    rng = np.random.default_rng(4)
    rows = []
    for seq in range(2):
        x = rng.normal(size=(n, 3)) * 0.2 + rng.normal(size=(5, 3))[rng.integers(0, 5, n)]
        x[::7] = x[0]  # ties at distance zero
        rows += [(seq, (i,), v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "seq_id long, ord struct<n:int>, item array<double>")


@pytest.mark.parametrize("exhaustive", [False, True])
@pytest.mark.parametrize("measured", [0, 4096])
def test_runs_are_the_automata_of_their_thresholds(monkeypatch, exhaustive, measured):
    monkeypatch.setattr(links, "MEASURED", measured)
    x = np.random.default_rng(2).normal(size=(50, 4))
    x[10:20] = x[:10]
    grid = [i / 200 for i in range(600)]
    runs = list(links.sweep_frames(x, grid, "euclidean", exhaustive))
    assert [t for own, _ in runs for t in own] == grid
    assert len(runs) < 400
    for own, linked in runs:
        for t in (own[0], own[-1]):
            assert links.link_frames(x, t, "euclidean", exhaustive) == linked


def test_a_missing_distance_never_matches():
    x = [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0, 1.0]]
    runs = list(links.sweep_frames(x, [0.0, 0.1, 5.0], "cosine"))
    assert [own for own, _ in runs] == [[0.0], [0.1, 5.0]]
    assert runs[1][1] == links.link_frames(x, 5.0, "cosine")


@pytest.mark.parametrize("method,limit", [("inc", 100_000), ("complete", 100_000), ("inc", 8)])
def test_sweep_equals_one_automaton_per_threshold(spark, method, limit):
    seqs = frames(spark, 60 if limit > 60 else 10)
    grid = rate.threshold_grid(0.0, 2.0, 0.05) if limit > 60 else [0.5]
    index, members = build_sweep(seqs, grid, "euclidean", method, limit)
    columns = ["seq_id", "threshold", "state", "sfx", "lrs", "label", "word", "word_end", "trn"]
    got = index.states.join(members, ["seq_id", "threshold"]).withColumn("threshold", members["member"]).select(columns)
    want = build_index(seqs, "variable", grid, "euclidean", method).states.select(columns)
    key = lambda r: tuple(r)[:3]
    a, b = (sorted((tuple(r[:8]) + (tuple(sorted(r.trn)),) for r in df.collect()), key=key) for df in (got, want))
    assert a == b
    if limit < 60:
        return
    best = {r.seq_id: r.threshold for r in rate.find_threshold(seqs, grid, metric="euclidean", method=method, limit=limit).collect()}
    sums = {(r.seq_id, r.threshold): r.ir for r in rate.threshold_rates(seqs, grid, metric="euclidean", method=method, limit=limit).collect()}
    assert len(sums) == 2 * len(grid)
    for seq, t in best.items():
        top = max(round(v, 9) for (s, _), v in sums.items() if s == seq)
        assert t == min(g for (s, g), v in sums.items() if s == seq and round(v, 9) == top)


def test_a_sweep_needs_thresholds(spark):
    with pytest.raises(ValueError):
        build_sweep(frames(spark), [])


@pytest.mark.parametrize("metric", ["cosine", "correlation"])
def test_few_targets_of_a_crowd_are_measured(monkeypatch, metric):
    x = np.random.default_rng(6).random((1500, 12))
    x[700:760] = x[:60]
    x[20] = 0.0  # no angle
    real, measured = links.row_metric, []

    def counted(name, frames):
        measure = real(name, frames)
        return lambda i, rows: measured.append(len(rows)) or measure(i, rows)

    monkeypatch.setattr(links, "row_metric", counted)
    monkeypatch.setattr(links, "MEASURED", 0)
    few = list(links.sweep_frames(x, [0.0, 0.001, 0.004], metric))
    asked = sum(measured)
    monkeypatch.setattr(links, "CROWD", 10**9)
    assert few == list(links.sweep_frames(x, [0.0, 0.001, 0.004], metric))
    assert asked < 0.3 * (sum(measured) - asked)
