"""Helpers against brute force and known structure."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import sequences_of
from seqloom import session
from seqloom.functions import cluster, distance
from seqloom.functions.draws import uniform, uniform_column
from seqloom.functions.scan import running, with_next
from seqloom.operators import generation, matching, segmentation, structure
from seqloom.operators.automaton import build_index
from seqloom.operators.links import link_symbols
from seqloom.operators.render import save_segments
from seqloom.operators.rate import threshold_grid
from seqloom.sources import sequences


@pytest.mark.parametrize("seed", range(30))
def test_link_invariants(seed):
    rng = random.Random(seed)
    items = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 60))]
    o = link_symbols(items)
    n = len(items)
    for i in range(1, n + 1):
        assert 0 <= o["sfx"][i] < i and o["lrs"][i] <= i - 1
        assert (o["sfx"][i] == 0) == (o["lrs"][i] == 0) == (items[i - 1] not in items[: i - 1])
        if o["sfx"][i]:
            assert o["label"][i] == o["label"][o["sfx"][i]]
        assert i in o["trn"][i - 1]
    ends, sizes = set(o["word_end"][1:]), 0
    for e in ends:
        sizes += e - o["word"][e]
    assert sizes == n


def test_running_in_blocks_is_running(spark):
    df = spark.range(1, 40).select((F.col("id") % 2).alias("g"), F.col("id").alias("i"), ((F.col("id") * 7) % 11).alias("v"))
    args = {"sums": {"s": F.col("v")}, "maxes": {"m": F.col("v")}}
    whole = running(df, ["g"], "i", 40, **args)
    blocked = running(df, ["g"], "i", 40, block=6, **args)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, blocked.select(whole.columns).collect()))
    dense = df.select("i", "v").withColumn("g", F.lit(1))
    a = with_next(dense, ["g"], "i", 40, n="v")
    b = with_next(dense, ["g"], "i", 40, block=6, n="v")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_numbering(spark):
    rng = random.Random(1)
    rows = [(s, (rng.randint(0, 50), j), f"{s}-{j}") for s in (1, 2) for j in range(200 if s == 1 else 3)]
    seqs = spark.createDataFrame(rows, "seq_id long, ord struct<a:int,b:int>, item string")
    got = {(r.seq_id, r.pos): r.item for r in sequences.number(seqs).collect()}
    want = {}
    for s in (1, 2):
        for p, r in enumerate(sorted(r for r in rows if r[0] == s), 1):
            want[s, p] = r[2]
    assert got == want


def test_draws_agree(spark):
    rows = spark.range(20).select("id", uniform_column("id", "id", 2).alias("u")).collect()
    assert [r.u for r in rows] == pytest.approx([uniform(r.id, r.id, 2) for r in rows])
    assert all(0 <= r.u < 1 for r in rows)


def test_grid():
    assert threshold_grid(0.0, 1.0, 0.1) == [i * 0.1 for i in range(10)]
    assert len(threshold_grid(0.0, 1.0, 0.001)) == 1000


def test_tonnetz_properties(spark):
    def chord(i):
        return F.array(*[F.lit(1.0 if j == i else 0.0) for j in range(12)])

    pairs = {"cc": (0, 0), "cd": (0, 2), "dc": (2, 0), "cg": (0, 7)}
    row = spark.range(1).select(*[distance.tonnetz(chord(a), chord(b)).alias(n) for n, (a, b) in pairs.items()]).first()
    assert row.cc == 0 and row.cd == pytest.approx(row.dc) and 0 < row.cg < row.cd
    zero = spark.range(1).select(distance.tonnetz(F.array(*[F.lit(0.0)] * 12), chord(0)).alias("d")).first()
    assert zero.d > 0


def test_ward_is_the_cheapest_merge():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, 2))
    parts = {i: [i] for i in range(9)}

    def cost(p, q):
        a, b = x[p].mean(axis=0), x[q].mean(axis=0)
        return np.sqrt(2 * len(p) * len(q) / (len(p) + len(q)) * ((a - b) ** 2).sum())

    for a, b, h in cluster.ward_heights(x):
        best = min((cost(parts[i], parts[j]), i, j) for i, j in itertools.combinations(parts, 2))
        assert h == pytest.approx(best[0]) and (a, b) == best[1:]
        parts[a] += parts.pop(b)
    doubled = np.repeat(x[:4], 2, axis=0)
    tall = [h for *_, h in cluster.ward_heights(doubled) if h > 0]
    assert tall == pytest.approx([h for *_, h in cluster.ward_heights(x[:4], [2] * 4)])


def test_ward_keeps_to_allowed_merges():
    x = [[0.0], [0.1], [5.0], [0.2]]
    chain = np.eye(4, k=1) + np.eye(4, k=-1)
    merges = cluster.ward_heights(x, allowed=chain)
    assert [m[:2] for m in merges] == [(0, 1), (2, 3), (0, 2)]
    assert [m[:2] for m in cluster.ward_heights(x)] == [(0, 1), (0, 3), (0, 2)]


def test_kmeans_finds_groups():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.1, size=(20, 2)) for c in (0, 3, 6)])
    assert cluster.kmeans(x, 3).tolist() == [0] * 20 + [1] * 20 + [2] * 20
    assert cluster.kmeans([[1.0], [1.0], [2.0]], 5).tolist() == [0, 0, 1]


def test_filters():
    x = np.array([[1.0, 9.0, 2.0, 3.0, 100.0]])
    assert cluster.median_filter(x, 3, 1).tolist() == [[1.0, 2.0, 3.0, 3.0, 100.0]]
    m = (np.random.default_rng(3).random((5, 5)) > 0.5).astype(float)
    assert (cluster.unlag_matrix(cluster.lag_matrix(m)) == m).all()


def test_laplacian_of_a_path():
    m = np.eye(4, k=1) + np.eye(4, k=-1)
    values = np.linalg.eigvalsh(cluster.normalized_laplacian(m))
    assert values[0] == pytest.approx(0) and values[-1] == pytest.approx(2)


def test_closest_states():
    assert matching.closest_states([[4, 9]]) == [4]
    assert matching.closest_states([[1, 10], [9, 20]]) == [10, 9]
    assert matching.closest_states([[1, 5], [6, 7], [7, 30]]) == [5, 6, 7]


def test_self_query_reconstructs(spark):
    rng = random.Random(5)
    seqs = sequences_of(spark, {7: [[rng.random(), rng.random()] for _ in range(25)]}, "frame")
    ix = build_index(seqs, "variable", 0.2)
    best = matching.best_path(matching.query_paths(ix, seqs, seqs)).orderBy("t").collect()
    assert [r.state for r in best] == list(range(1, 26)) and best[-1].total == pytest.approx(0)


def test_walker_weights():
    items = list("abcabdabcabcabd" * 2)
    o = link_symbols(items)
    walker = generation.Walker(o["label"], o["lrs"], o["sfx"], o["trn"], 3)
    for weight in (None, "max", "weight"):
        out, last, trace = walker.generate(50, p=0.4, weight=weight)
        assert all(1 <= s <= len(items) for s in out) and 0 <= last < len(items) and trace[0] == 1
    k = 9
    chain = [k]
    while chain[-1]:
        chain.append(o["sfx"][chain[-1]])
    want = set(chain[1:]) | {i for i, s in enumerate(o["sfx"]) if s in chain[:-1]}
    assert walker.relatives(k) == sorted(want)
    out, _, _ = walker.improvise(20, continuity=3, lrs=1, weight="lrs")
    assert out[:3] == [1, 2, 3] and len(out) >= 20


def test_segments_of_clear_parts(spark):
    seqs = sequences_of(spark, {1: list("a" * 12 + "b" * 12 + "a" * 12)})
    ix = build_index(seqs)
    for method in ("symbol_agglomerative", "symbol_spectral_agglomerative"):
        rows = segmentation.segmentation(ix, method, connectivity="rsfx").orderBy("seg").collect()
        assert [(r.start, r.end) for r in rows] == [(0, 12), (12, 24), (24, 35)], method
        assert [r.label for r in rows] == [0, 1, 0], method
    with pytest.raises(ValueError):
        segmentation.segmentation(ix, "none")
    with pytest.raises(TypeError):
        segmentation.segmentation(None)


def test_novelty_peaks_stand_out(spark):
    curves = {1: [0, 0, 0, 0, 0, 0.2, 0.9, 0.2, 0, 0, 0, 0.01, 0], 2: [0, 0.9, 0, 0.8, 0], 3: [0, 0.5, 0.5, 0, 0, 0, 0, 0, 0, 0.7], 4: [0]}
    rows = [(k, i, len(c), float(v)) for k, c in curves.items() for i, v in enumerate(c)]
    curve = spark.createDataFrame(rows, "seq_id long, frame int, n int, novelty double")
    found = structure.peaks(curve, ["seq_id"], 0.05)
    assert sorted(map(tuple, found.collect())) == [(1, 6), (3, 9)]
    spans = structure.spans_between(curve, found, ["seq_id"]).orderBy("seq_id", "seg").collect()
    assert [tuple(r) for r in spans] == [(1, 0, 0, 6), (1, 1, 6, 12), (2, 0, 0, 4), (3, 0, 0, 9), (3, 1, 9, 9), (4, 0, 0, 0)]


def plain_diagonal(block):
    best, value = 0.0, {}
    for i, row in enumerate(block):
        for j, hit in enumerate(row):
            steps = [value.get((i - 1, j - 1), 0), value.get((i - 2, j - 1), 0), value.get((i - 1, j - 2), 0)]
            value[i, j] = hit + (max(steps) if i and j else 0)
            best = max(best, value[i, j])
    return best / min(len(block), len(block[0]))


def test_diagonal_scores_and_names(spark):
    rng = np.random.default_rng(4)
    bounds = [0, 5, 12, 13, 20]
    m = (rng.random((20, 20)) > 0.6).astype(int)
    m[13:18, 0:5] = np.eye(5)
    m = m | m.T
    cells = spark.createDataFrame([(1, int(i), int(j)) for i, j in zip(*np.nonzero(m))], "seq_id long, i int, j int")
    spans = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))], "seq_id long, seg int, start int, end int")
    scores = structure.diagonal_scores(cells, spans, ["seq_id"])
    got = {(r.a, r.b): r.score for r in scores.collect()}
    for a in range(4):
        for b in range(4):
            both = [m[bounds[x] : bounds[x + 1], bounds[y] : bounds[y + 1]].tolist() for x, y in ((a, b), (b, a))]
            assert got.get((a, b), 0.0) == pytest.approx(sum(map(plain_diagonal, both)) / 2)
    rows = [(1, 0, 0, 1.0), (1, 0, 2, 1.0), (1, 2, 0, 1.0), (1, 2, 2, 1.0), (1, 1, 1, 0.4), (1, 4, 4, 1.5), (1, 3, 4, 1.2), (1, 4, 3, 1.2)]
    five = spark.createDataFrame([(1, k, k, k + 1) for k in range(5)], "seq_id long, seg int, start int, end int")
    named = structure.repeat_names(spark.createDataFrame(rows, "seq_id long, a int, b int, score double"), five, ["seq_id"])
    assert [r.label for r in named.orderBy("seg").collect()] == [1, 0, 1, 4, 4]


def test_shared_folder_is_required_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session)
    Context.master = "local[4]"
    assert session.checkpoint_dir(Session) == session.checkpoint_dir(Session)


def test_prediction_on_numbers_and_unseen_symbols(spark):
    from math import log2

    from seqloom.operators import predict

    seqs = spark.createDataFrame([(1, (i,), x) for i, x in enumerate([1, 2, 2, 3, 1, 2])], "seq_id long, ord struct<n:int>, item int")
    contexts = spark.createDataFrame([(1, 0, [1, 2])], "seq_id long, ctx_id long, context array<int>")
    got = {r.symbol: r.prob for r in predict.predict(seqs, contexts).collect()}
    assert set(got) == {1, 2, 3} and sum(got.values()) == pytest.approx(1)
    model = predict.Model([1, 2, 2, 3, 1, 2])
    counts, _ = model.predict([])
    assert model.log_loss([9])[0] == pytest.approx(log2(counts.sum()))


def test_label_file(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "seq_id long, seg int, line string")
    save_segments(lines, str(tmp_path / "lab"))
    files = list((tmp_path / "lab" / "seq_id=1").glob("*.txt"))
    assert len(files) == 1 and files[0].read_text() == "a\nb\n"


def test_ward_chains_find_the_same_tree():
    rng = np.random.default_rng(3)
    for _ in range(5):
        x = np.repeat(rng.normal(size=(40, 3)), 2, axis=0)  # copies merge first
        matrix, chains = cluster.ward_heights(x), cluster.ward_heights(x, matrix=0)
        assert np.allclose(sorted(h for *_, h in matrix), sorted(h for *_, h in chains))
        for height in (0.0, 1.0, 3.0):
            assert cluster.cut_at(80, matrix, height).tolist() == cluster.cut_at(80, chains, height).tolist()


def test_ward_holds_no_matrix_of_many_points():
    import tracemalloc

    x = np.random.default_rng(4).normal(size=(5000, 2))
    tracemalloc.start()
    merges = cluster.ward_heights(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merges) == 4999 and peak < 5000 * 5000 * 8 / 10


def test_raw_tree_over_more_frames_than_a_matrix(spark, monkeypatch):
    monkeypatch.setattr(segmentation, "DENSE", 8)
    frames = sequences_of(spark, {1: [[0.0, 0.1]] * 6 + [[5.0, 5.1]] * 6 + [[0.0, 0.1]] * 6}, "frame")
    index = build_index(frames, "variable", 0.5)
    got = sorted(map(tuple, segmentation.segmentation(index, seqs=frames, data="raw").select("seg", "start", "end", "label").collect()))
    assert got == [(0, 0, 6, 0), (1, 6, 12, 1), (2, 12, 17, 0)]


def test_raw_tree_takes_no_frame_apart(spark, monkeypatch):
    rng = np.random.default_rng(14)
    points = {s: (np.repeat(rng.normal(size=(4, 3)) * 5, 5, axis=0) + rng.normal(size=(20, 3))).tolist() for s in (1, 2)}
    frames = sequences_of(spark, points, "frame")
    index = build_index(frames, "variable", 2.0, "euclidean")
    monkeypatch.setattr(segmentation, "raw_features", lambda *args: pytest.fail("a row for every number of a frame"))
    rows = segmentation.segmentation(index, seqs=frames, data="raw").collect()
    got = {s: sorted((r.seg, r.start, r.end, r.label) for r in rows if r.seq_id == s) for s in points}
    for s, x in points.items():
        merges = cluster.ward_heights(x)
        flat = cluster.cut_at(20, merges, 0.7 * max(h for *_, h in merges))
        change = [i for i in range(1, 19) if flat[i] != flat[i - 1]]  # the last frame opens no segment
        bounds = [0, *change, 20]
        means = [np.mean(x[a:b], axis=0) for a, b in zip(bounds, bounds[1:])]
        label = cluster.kmeans(means, flat.max() + 1).tolist()
        ends = [*change, 19]
        assert got[s] == [(i, a, b, n) for i, (a, b, n) in enumerate(zip(bounds, ends, label))]


def test_matrices_out_of_rows():
    frames = [[1.0, 2.0], None, [3.0], [], [4.0, None, 5.0], [], None]
    kind = pa.list_(pa.list_(pa.float64()))
    got = segmentation._frames(pa.array([[[9.0]], frames], kind)[1])
    assert np.array_equal(got, [[1, 2, 0], [0, 0, 0], [3, 0, 0], [0, 0, 0], [4, np.nan, 5]], equal_nan=True)
    assert segmentation._frames(pa.array([[None, []]], kind)[0]).shape == (0, 0)
    rows = [{"seg": 2, "means": [None, 7.0, None]}, {"seg": 0, "means": [1.0, None, None]}, {"seg": 4, "means": [None] * 3}]
    kind = pa.list_(pa.struct([("seg", pa.int32()), ("means", pa.list_(pa.float64()))]))
    assert segmentation._dense(pa.array([[], rows], kind)[1]).tolist() == [[1, 0], [0, 0], [0, 7]]


def test_starts_of_kmeans_in_parts(monkeypatch):
    x = np.random.default_rng(15).normal(size=(150, 4))
    whole = cluster.kmeans(x, 5)
    monkeypatch.setattr(cluster, "SEEDS", 1000)
    assert (cluster.kmeans(x, 5) == whole).all()


def test_kmeans_in_parts_is_kmeans(monkeypatch):
    x = np.random.default_rng(5).normal(size=(150, 4))
    whole = cluster.kmeans(x, 4)
    monkeypatch.setattr(cluster, "CELLS", 3000)
    assert (cluster.kmeans(x, 4) == whole).all()


def test_written_tables_are_not_broadcast(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "t"))
    small = spark.read.parquet(str(tmp_path / "t"))
    plan = spark.range(1000).join(session.beside(small).groupBy("id").count(), "id")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_segmentation_plans_have_no_broadcast(spark):
    index = build_index(sequences_of(spark, {1: list("aabbaabb"), 2: list("abab")}))
    plan = segmentation.segmentation(index, hier=True)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_temporal_spectrum_is_found_once_a_length(spark, monkeypatch):
    table = {i: list("abc" * n) for i, n in enumerate([7, 7, 4, 7, 4])}
    index = build_index(sequences_of(spark, table))
    real, asked = segmentation._spectra, []

    def spectra(ix, *how):
        asked.append(ix.states.select("seq_id").distinct().count())
        return real(ix, *how)

    columns = ["seq_id", "cut", "seg", "start", "end", "label"]
    want = sorted(map(tuple, segmentation._spectral(index, "temporal", True, 2, 10, 9).select(columns).collect()))
    monkeypatch.setattr(segmentation, "_spectra", spectra)
    got = segmentation.spectral(index, hier=True).select(columns)
    assert sorted(map(tuple, got.collect())) == want and {r[0] for r in want} == set(table) and asked == [2]


def test_kmeans_of_many_points_holds_few_runs_at_once():
    x = np.random.default_rng(6).normal(size=(4096, 9))
    tracemalloc.start()
    labels = cluster.kmeans(x, 9, steps=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(labels.tolist())) == 9 and most < 40e6


def test_kmeans_is_the_plain_one():
    def plain(x, centres):
        for _ in range(300):
            label = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c for j, c in enumerate(centres)])
            if (new == centres).all():
                return label
            centres = new

    x = np.random.default_rng(7).normal(size=(60, 3))
    got = cluster.kmeans(x, 4, restarts=1)
    again = plain(x, np.array([x[got == j].mean(axis=0) for j in range(4)]))
    assert (again == got).all()


def test_ward_heights_with_ties_weights_and_links():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (30, 2)).astype(float)
    merges = cluster.ward_heights(x, rng.integers(1, 4, 30), rng.random((30, 30)) < 0.2)
    assert len(merges) == 29 and len({b for _, b, _ in merges}) == 29 and all(a < b for a, b, _ in merges)
    distinct = len(np.unique(x, axis=0))
    assert sum(h == 0 for *_, h in cluster.ward_heights(x)) == 30 - distinct


@pytest.mark.parametrize("method", ["symbol_spectral", "symbol_spectral_agglomerative"])
def test_spectral_rows_are_pooled_without_a_join(spark, monkeypatch, method):
    index = build_index(sequences_of(spark, {1: list("aaaabbbbaaaaccccbbbb"), 2: list("abcabcabcddddabcabc"), 3: list("ab")}))
    joined = []
    real = segmentation.pooled
    monkeypatch.setattr(segmentation, "pooled", lambda *args: joined.append(1) or real(*args))
    rows = segmentation.segmentation(index, method, connectivity="rsfx").collect()
    assert {r.seq_id for r in rows} == {1, 2, 3} and not joined


def test_pooled_rows_are_pooled(spark):
    parts = spark.createDataFrame(
        [(1, 1, 0, [1.0, 2.0]), (1, 2, 0, [3.0, 5.0]), (1, 3, 1, [7.0, 0.0]), (2, 1, 0, [4.0])],
        "seq_id long, state int, seg int, y array<double>",
    )
    cells = parts.select("seq_id", "state", F.posexplode("y").alias("dim", "x"))
    want = segmentation.pooled(parts.drop("y"), cells, ["seq_id"], ["seq_id"]).collect()
    got = segmentation.pooled_rows(parts, ["seq_id"], "y", 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
