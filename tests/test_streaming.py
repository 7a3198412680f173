"""Streams cut into micro-batches give what one batch gives, also across a restart."""

import random
import time

import pytest

from conftest import sequences_of
from seqloom.operators import tracker
from seqloom.operators.links import link_frames, link_symbols
from seqloom.streaming import frames, live


def write(spark, rows, schema, path, part):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={part}")
    time.sleep(1.1)  # files are taken in order of their modification times


@pytest.fixture
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def read(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def test_automaton_grows_over_batches_and_restarts(spark, tmp_path, two_partitions):
    table = {1: list("abbcabcdabc"), 2: list("xyxyyxxyxy")}
    schema, path = "seq_id long, pos long, item string", str(tmp_path / "in")
    rows = [(s, p, x) for s, items in table.items() for p, x in enumerate(items, 1)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    write(spark, [r for r in rows if r[1] <= 4], schema, path, 1)
    write(spark, [r for r in rows if 4 < r[1] <= 7], schema, path, 2)
    live.run_available(live.grow_stream(read(spark, schema, path)), out, state)
    write(spark, [r for r in rows if r[1] > 7], schema, path, 3)
    grown = live.run_available(live.grow_stream(read(spark, schema, path)), out, state)
    got = sorted(map(tuple, grown.collect()))
    want = []
    for s, items in table.items():
        o = link_symbols(items)
        want += [(s, i, o["sfx"][i], o["lrs"][i], o["label"][i]) for i in range(1, len(items) + 1)]
    assert got == sorted(want)


def test_tracking_over_batches(spark, tmp_path, two_partitions):
    rng = random.Random(9)
    frames = [[rng.random() + 0.1, rng.random() + 0.1, rng.random() + 0.1] for _ in range(24)]
    models = tracker.fit(sequences_of(spark, {5: frames}, "frame"), [0.02, 0.05, 0.1])
    seen = [(5, p, x) for p, x in enumerate(frames[3:15], 1)]
    schema, path = "seq_id long, pos long, item array<double>", str(tmp_path / "in")
    write(spark, seen[:5], schema, path, 1)
    write(spark, seen[5:], schema, path, 2)
    stream = live.track_stream(read(spark, schema, path), models)
    followed = live.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    batch = tracker.track(models, sequences_of(spark, {5: frames[3:15]}, "frame"))
    assert sorted(map(tuple, followed.collect())) == sorted(map(tuple, batch.collect()))


def test_reset_and_tied_times(spark, tmp_path, two_partitions):
    rng = random.Random(3)
    frames = [[rng.random() + 0.1, rng.random() + 0.1] for _ in range(12)]
    models = tracker.fit(sequences_of(spark, {5: frames}, "frame"), [0.02, 0.1])
    rows = [(5, i // 2, i % 2, x, again) for again in (False, True) for i, x in enumerate(frames[2:8], 6 * again)]
    rows = [(s, a, b, x, again and i == 6) for i, (s, a, b, x, again) in enumerate(rows)]
    rng.shuffle(rows)
    schema, path = "seq_id long, ts long, event_id long, item array<double>, reset boolean", str(tmp_path / "in")
    write(spark, rows, schema, path, 1)
    stream = live.track_stream(read(spark, schema, path), models, ["ts", "event_id"])
    got = [r.frame for r in sorted(live.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect(), key=lambda r: r.t)]
    once = [r.frame for r in tracker.track(models, sequences_of(spark, {5: frames[2:8]}, "frame")).orderBy("t").collect()]
    assert got == once * 2


def city():
    return lambda x, others: abs(others - x).sum(axis=1)  # made in a function, so it travels by value


@pytest.mark.parametrize(
    "metric,method,own",
    [("euclidean", "inc", False), ("cosine", "complete", True), ("function", "inc", False)],
    ids=["euclidean", "cosine", "function"],
)
def test_frames_grow_over_batches_and_restarts(spark, tmp_path, two_partitions, metric, method, own):
    rng, metric = random.Random(8), city() if metric == "function" else metric
    table = {s: [[rng.choice((0.0, 1.0, 4.0)) + rng.random(), rng.random(), rng.random()] for _ in range(60)] for s in (1, 2)}
    table[2][5] = [0.0, 0.0, 0.0]
    table[1][9] = table[1][3]
    thresholds = {1: 0.5, 2: 0.3} if metric != "cosine" else {1: 0.05, 2: 0.02}
    given = spark.createDataFrame(list(thresholds.items()), "seq_id long, threshold double") if own else thresholds[1]
    schema, path = "seq_id long, pos long, item array<double>", str(tmp_path / "in")
    rows = [(s, p, x) for s, items in table.items() for p, x in enumerate(items, 1)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    write(spark, [r for r in rows if r[1] <= 25], schema, path, 1)
    live.run_available(frames.grow_frames(read(spark, schema, path), given, metric, method=method), out, state)
    write(spark, [r for r in rows if r[1] > 25], schema, path, 2)
    grown = live.run_available(frames.grow_frames(read(spark, schema, path), given, metric, method=method), out, state)
    got = sorted(map(tuple, grown.collect()))
    want, compared = [], 0
    for s, items in table.items():
        o = link_frames(items, thresholds[s if own else 1], metric, method == "complete")
        want += [(s, i, o["sfx"][i], o["lrs"][i], o["label"][i]) for i in range(1, len(items) + 1)]
    assert [r[:5] for r in got] == sorted(want)


def test_pivots_leave_few_targets_to_measure():
    rng = random.Random(5)
    items = [[rng.random() * 100] for _ in range(400)]

    class Table(dict):
        def __getitem__(self, key):
            return self.get(key)

    def grown(metric):
        cells = {n: Table() for n in ("frame", "pivot", "filled", "part")}
        targets = frames.Targets(cells, metric, 0.5)
        sfx, lrs, label, twin, fresh = {0: -1}, {0: 0}, {0: -1}, {}, 0
        for i, x in enumerate(items, 1):
            targets.enter(i, x)
            fresh += live.add_state(i, fresh, label, sfx, lrs, twin, targets.hit, targets.link)
        return sfx, lrs, label, targets.measured

    near, every = grown("euclidean"), grown(city())
    assert near[:3] == every[:3] and near[3] < 0.2 * every[3]


def test_late_rows_wait_or_are_dropped(spark, tmp_path, two_partitions):
    """Rows out of order within the delay give the batch result; those beyond it are counted."""
    schema, path = "seq_id long, at long, pos long, item string", str(tmp_path / "in")
    items = {1: list("abbcabcdabcabd"), 2: list("xyxyyxxyxyxyyx")}
    rows = [(s, 10 * p, p, x) for s, own in items.items() for p, x in enumerate(own, 1)]
    early, middle, last = ([r for r in rows if a < r[1] <= b] for a, b in ((0, 60), (60, 100), (100, 140)))
    held = [r for r in early if r[1] == 50]  # comes one batch later, still in time
    write(spark, [r for r in reversed(early) if r not in held], schema, path, 1)
    write(spark, held + middle, schema, path, 2)
    write(spark, [(1, 20, 99, "z"), *last], schema, path, 3)  # long past
    write(spark, [(s, 400, 100, "q") for s in items], schema, path, 4)  # moves the watermark beyond all others
    stream = read(spark, schema, path)
    timed = stream.withColumn("ts", stream["at"].cast("timestamp")).withWatermark("ts", "30 seconds")
    told = []
    grown = live.run_available(live.grow_stream(timed, "pos", "ts"), str(tmp_path / "out"), str(tmp_path / "state"), told)
    want = []
    for s, own in items.items():
        o = link_symbols(own)
        want += [(s, i, o["sfx"][i], o["lrs"][i], o["label"][i]) for i in range(1, len(own) + 1)]
    assert sorted(map(tuple, grown.collect())) == sorted(want) and told == [1]


class _Map:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_neighbours_share_an_entry():
    state, want = _Map(), {}
    first = live.Buckets(state, int, new=True)
    for i in range(64):
        first[(i, i % 5)] = want[(i, i % 5)] = i * i
    first.flush()
    assert state.calls == 2  # 64 cells, two entries, none read
    again = live.Buckets(state, int)
    again[(3, 3)] = want[(3, 3)] = -1
    assert all(again.get(k) == v for k, v in want.items()) and again.get((3, 4)) is None and again[(99, 0)] is None
    again.flush()
    last = live.Buckets(state, int)
    assert all(last[k] == v for k, v in want.items()) and len(state.held) == 2
