"""Walks by rounds of joins take the same steps as the walks inside a task."""

import random

import pytest

from conftest import sequences_of
from seqloom.operators import hmm, matching, motifs, predict
from seqloom.operators.automaton import build_index


@pytest.mark.parametrize(
    "how",
    [
        {"policy": "suffix", "nearest": True},
        {"policy": "forward_self", "nearest": True, "weight": 0.4},
        {"policy": "forward", "nearest": False, "expand": False, "decay": 0.5},
    ],
)
def test_rounds_equal_task(spark, how):
    rng = random.Random(6)
    points = {s: [[rng.random(), rng.random()] for _ in range(20)] for s in (1, 2)}
    seqs = sequences_of(spark, points, "frame")
    obs = sequences_of(spark, {1: points[2][:14], 2: points[1][3:7]}, "frame")
    ix = build_index(seqs, "variable", 0.3)

    def steps(limit):
        rows = matching._walks(ix, seqs, obs, None, limit=limit, **how).collect()
        return sorted((r.obs_id, r.seq_id, r.start, r.t, r.state, round(r.cost, 9)) for r in rows)

    assert steps(1) == steps(100)


def test_long_fragments_and_medians(spark):
    items = list("abbcabcdabc" * 2 + "abcdabcabcd")
    ix = build_index(sequences_of(spark, {1: items, 2: list("aaaaab")}))
    assert sorted(motifs.find_fragments(ix, limit=1).collect()) == sorted(motifs.find_fragments(ix).collect())

    rng = random.Random(8)
    seqs = sequences_of(spark, {s: [[rng.randint(0, 9) / 10] for _ in range(21)] for s in (1, 2)}, "frame")
    frames = build_index(seqs, "variable", 0.25)
    short, long = (hmm.cluster_medians(frames, seqs, limit=n) for n in (100, 1))
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, long.select(short.columns).collect()))


def test_long_prediction(spark):
    seqs = sequences_of(spark, {1: list("abbcabcdabcabdc"), 2: list("xyxyyx")})
    asked = [
        (1, 0, ["a", "b"]), (1, 1, ["x", "b"]), (1, 2, []), (1, 3, ["c", "a", "b", "d"]), (1, 4, ["z"]),
        (2, 0, ["x", "y", "x"]), (2, 1, ["y", "y", "y"]),
    ]
    contexts = spark.createDataFrame(asked, "seq_id long, ctx_id long, context array<string>")

    def told(limit):
        said = predict.predict(seqs, contexts, limit=limit).collect()
        took = predict.accept(seqs, contexts, limit=limit).collect()
        rows = [(r.seq_id, r.ctx_id, r.used, r.symbol, round(r.prob, 9)) for r in said]
        return sorted(rows), sorted(map(tuple, took))

    assert told(1) == told(100)


def test_repeat_runs_and_tiles(spark):
    from seqloom.operators import similarity

    rng = random.Random(3)
    table = {1: list("abbcabcdabc") * 4, 2: ["a"] * 60, 3: [rng.choice("ab") for _ in range(80)], 4: list("xyz")}
    ix = build_index(sequences_of(spark, table))
    want = {s: set() for s in table}
    for r in ix.frames.where("lrs > 0").collect():
        for k in range(r.lrs):
            want[r.seq_id] |= {(r.state - k, r.sfx - k), (r.sfx - k, r.state - k)}
    runs = similarity.repeat_runs(ix).collect()
    per = {s: sorted((r.d, r.start, r.end) for r in runs if r.seq_id == s) for s in table}
    assert per[2] == [(1, 2, 60)] and per[4] == []
    for own in per.values():  # no two runs of a diagonal touch
        assert all(a[0] < b[0] or a[2] + 1 < b[1] for a, b in zip(own, own[1:]))
    cells = [tuple(r) for r in similarity.self_similarity(ix, "lrs").collect()]
    assert len(cells) == len(set(cells)) and set(cells) == {(s, *c) for s in table for c in want[s]}
    tile = {tuple(r) for r in similarity.repeat_tile(ix, (10, 30), (5, 20)).collect()}
    assert tile == {(s, i, j) for s, i, j in cells if 10 <= i <= 30 and 5 <= j <= 20}


def test_suffix_intervals(spark):
    from seqloom.operators import tours

    table = {1: list("abbcabcdabc"), 2: ["a"] * 40, 3: list("abcd"), 4: ["a"]}
    ix = build_index(sequences_of(spark, table))
    sfx = {(r.seq_id, r.state): r.sfx for r in ix.states.collect()}
    at = {(r.seq_id, r.state): (r.enter, r.leave) for r in tours.suffix_intervals(ix).collect()}
    assert set(at) == set(sfx)
    for s, x in table.items():
        assert sorted(n for (q, _), pair in at.items() if q == s for n in pair) == list(range(2 * len(x) + 2))
        for i in range(len(x) + 1):
            chain, k = set(), i
            while k is not None:
                chain.add(k)
                k = sfx[s, k]
            inside = {j for j in range(len(x) + 1) if at[s, j][0] <= at[s, i][0] and at[s, i][1] <= at[s, j][1]}
            assert inside == chain


def test_bounded_tours_are_the_ranked_ones(spark):
    from seqloom.operators import tours

    ix = build_index(sequences_of(spark, {1: list("abaabbabab"), 2: list("aaaa"), 3: ["x"]}))
    for fn in (tours.suffix_intervals, tours.subtrees):
        assert sorted(map(tuple, fn(ix).collect())) == sorted(map(tuple, fn(ix, limit=0).collect()))
    assert tours.subtrees(ix)._jdf.queryExecution().executedPlan().toString().count("Join") == 0  # one grouping of the states


def test_blended_walks_measure_a_state_once():
    import numpy as np

    from seqloom.operators.links import link_frames

    rng = random.Random(8)
    items = [[rng.random(), rng.random()] for _ in range(60)]
    asked = [[rng.random(), rng.random()] for _ in range(40)]
    o = link_frames(items, 0.3)
    calls = []

    def metric(x, others):
        calls.append(tuple(x))
        return ((others - x) ** 2).sum(axis=1)

    def walk(metric):
        how = {"policy": "forward_self", "nearest": True, "weight": 0.5, "metric": metric}
        return matching._walk(items, o["label"], o["sfx"], o["trn"], asked, None, **how)

    own = walk(metric)
    assert len(calls) == len(set(calls))
    assert all(np.array_equal(a, b) for a, b in zip(own, walk("sqeuclidean")))


@pytest.mark.parametrize("expand", [True, False])
def test_blended_walks_measure_only_frames_within_reach(monkeypatch, expand):
    import numpy as np

    from seqloom.operators.links import link_frames

    rng = np.random.default_rng(10)
    items = (rng.integers(0, 12, (120, 1)) * 10 + rng.random((120, 2))).tolist()  # twelve clusters far apart
    asked = (rng.integers(0, 12, (50, 1)) * 10 + rng.random((50, 2))).tolist()
    o = link_frames(items, 3.0)
    label, x, q = np.array(o["label"][1:]), np.array(items), np.array(asked)
    child, measured = matching._first_children(o["sfx"]), []

    def counted(metric, frames):
        def metre(i, rows):
            measured.append(len(frames[rows]))
            return ((frames[rows] - frames[i]) ** 2).sum(axis=1)

        return metre

    monkeypatch.setattr(matching, "row_metric", counted)
    how = {"policy": "forward_self", "nearest": True, "weight": 0.5, "expand": expand}
    got = matching._walk(items, o["label"], o["sfx"], o["trn"], asked, None, **how)

    def reached(p):
        near = matching._reach(o["sfx"], o["trn"], child, p, "forward_self")
        return [[j - 1] if not expand else np.flatnonzero(label == label[j - 1]).tolist() for j in near]

    states = {}
    for start, t, state, cost in zip(*got):
        d = ((x - q[t - 1]) ** 2).sum(axis=1)
        if t > 1:
            p, before = states[start]
            if p < len(x):
                d = d * 0.5 + 0.5 * ((x - x[p]) ** 2).sum(axis=1)
            i = min((i for group in reached(p) for i in group), key=d.__getitem__)
            assert (state, cost) == (i + 1, before + d[i])
        states[start] = state, cost
    visited = {int(p) for p in got[2] if p < len(x)}
    assert sum(measured) <= sum(len({i for group in reached(p) for i in group}) for p in visited)
    assert sum(measured) < 0.6 * len(visited) * len(x)  # it was every frame of the model


def test_chunks_of_one_call_walk_on_their_own(spark):
    import numpy as np

    from seqloom.operators.links import link_frames

    rng = random.Random(9)
    items = [[rng.random(), rng.random()] for _ in range(50)]
    asked = [[rng.random(), rng.random()] for _ in range(20)]
    o = link_frames(items, 0.2)
    for weight in (None, 0.5):
        how = {"policy": "forward_self", "nearest": True, "weight": weight}
        got = matching._walk(items, o["label"], o["sfx"], o["trn"], asked, None, **how, factor=3)
        want = []
        for at in range(0, 20, 3):
            start, t, state, cost = matching._walk(items, o["label"], o["sfx"], o["trn"], asked[at : at + 3], None, **how)
            best = min((c, s) for c, s, u in zip(cost, start, t) if u == t.max())[1]
            want += [(s, u + at, p, c) for s, u, p, c in zip(start, t, state, cost) if s == best]
        assert list(zip(*got)) == want and np.all(got[1] == np.arange(1, 21))

    seqs = sequences_of(spark, {1: items, 2: items[:7], 3: items[:1]}, "frame")
    index = build_index(seqs, "variable", 0.2, "euclidean")
    steps = matching._walks(index, seqs, seqs, None, factor=3, policy="forward_self", nearest=True, weight=None)
    kept = sorted((r.obs_id, r.chunk, r.t) for r in steps.collect())  # one path a chunk leaves the task
    assert kept == sorted((s, i // 3, i % 3 + 1) for s, n in ((1, 50), (2, 7), (3, 1)) for i in range(n))
