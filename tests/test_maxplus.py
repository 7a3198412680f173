"""Scores and tracks of long observation sequences equal those of the in-task forms."""

import random

import numpy as np
import pytest

from conftest import sequences_of
from seqloom.operators import hmm, maxplus, tracker
from seqloom.operators.automaton import build_index
from seqloom.operators.hmm import log_transitions


def frames(seed, n):
    r = random.Random(seed)
    centres = [[r.random() + 0.1 for _ in range(3)] for _ in range(5)]
    return [[c + 0.05 * r.random() for c in r.choice(centres)] for _ in range(n)]


def cells_of(rng, n):
    out = []
    for i in range(n):
        to = rng.choice(n, rng.integers(0, n), replace=False)
        p = rng.random(len(to))
        unseen = 0.01 * rng.integers(0, 2)
        out += [{"from": i, "to": int(j), "prob": float(x) / p.sum() + unseen, "unseen": unseen} for j, x in zip(to, p)]
    return out


def test_cells_and_row_constants_step_like_the_whole_matrix():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 20):
        for cells in (cells_of(rng, n), []):
            a, whole = maxplus.Transitions(n, cells), log_transitions(n, cells)
            u = rng.normal(size=(4, n))
            assert np.allclose(a.step(u), (u[:, :, None] + whole).max(axis=1))
            step, back = a.best(u[0])
            sums = u[0][:, None] + whole
            assert np.allclose(step, sums.max(axis=0)) and (back == sums.argmax(axis=0)).all()
    v = np.zeros(3)  # all ways tie: the smallest label wins
    assert maxplus.Transitions(3, []).best(v)[1].tolist() == [0, 0, 0]


@pytest.fixture
def small_blocks(monkeypatch, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("smooth", [False, True])
def test_recognition_in_blocks(spark, monkeypatch, small_blocks, smooth):
    monkeypatch.setattr(maxplus, "STARTS", 3)
    known = sequences_of(spark, {1: frames(1, 60), 2: frames(2, 40), 3: frames(3, 20)}, "frame")
    obs = sequences_of(spark, {1: frames(1, 55), 2: frames(4, 9), 3: frames(5, 21)}, "frame")
    index = build_index(known, "variable", 0.02, "cosine")
    real = maxplus.in_blocks
    monkeypatch.setattr(maxplus, "in_blocks", lambda o, m: real(o, m, 8))
    monkeypatch.setattr(maxplus, "BLOCK", 8)
    once = sorted(map(tuple, hmm.recognition(index, known, obs, 1, smooth).collect()), key=lambda r: r[:3])
    parts = sorted(map(tuple, hmm.recognition(index, known, obs, 1, smooth, limit=20).collect()), key=lambda r: r[:3])
    assert len(once) == len(parts) > 300
    for a, b in zip(once, parts):
        assert (a[:3], a[4]) == (b[:3], b[4]) and abs(a[3] - b[3]) < 1e-9


@pytest.mark.parametrize("rule,decay", [("predicted", 1.0), ("observed", 0.9)])
def test_tracking_in_blocks(spark, monkeypatch, small_blocks, rule, decay):
    monkeypatch.setattr(maxplus, "STARTS", 4)
    known = sequences_of(spark, {1: frames(1, 60), 2: frames(2, 40)}, "frame")
    obs = sequences_of(spark, {1: frames(1, 70), 2: frames(2, 21)}, "frame")
    models = tracker.fit(known, [0.005, 0.01, 0.02])
    real = maxplus.in_blocks
    monkeypatch.setattr(maxplus, "in_blocks", lambda o, m: real(o, m, 10))
    once = sorted(map(tuple, tracker.track(models, obs, decay, rule).collect()))
    assert sorted(map(tuple, tracker.track(models, obs, decay, rule, limit=20).collect())) == once and len(once) == 91


def test_scores_leave_a_task_in_small_batches(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    med, items = rng.random(5 * 3).tolist(), rng.random((41, 3)).tolist()
    model = {"seq_id": 7, "items": items, "n_labels": 5, "med": med, "cells": cells_of(rng, 5)}
    batch = pa.RecordBatch.from_pylist([model, model | {"seq_id": 8, "items": items[:1]}])
    whole = pa.Table.from_batches(hmm._viterbi([batch])).to_pylist()
    monkeypatch.setattr(hmm, "CELLS", 20)
    parts = list(hmm._viterbi([batch]))
    assert max(len(p) for p in parts) == 20 and len(parts) == 12
    assert pa.Table.from_batches(parts).to_pylist() == whole and len(whole) == 42 * 5
    assert [r["t"] for r in whole if r["back"] is None] == [41] * 5 + [1] * 5
