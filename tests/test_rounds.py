"""The join rounds for long sequences give the states of the in-task construction."""

import random

import pytest

from conftest import sequences_of
from seqloom.operators import rounds
from seqloom.operators.automaton import build_index

COLUMNS = ["seq_id", "state", "sfx", "lrs", "label", "prev_label", "word", "word_end", "trn"]


def rows(index):
    return sorted(tuple(r) for r in index.states.select(*COLUMNS).collect())


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_only_long_symbol_sequences_take_rounds(spark, monkeypatch, one_partition):
    seen = []
    inner = rounds.link_by_rounds

    def spy(seqs, *args):
        seen.extend(sorted(r[0] for r in seqs.select("seq_id").distinct().collect()))
        return inner(seqs, *args)

    monkeypatch.setattr(rounds, "link_by_rounds", spy)
    table = {1: list("abbcabcdabc"), 2: list("abab"), 3: list("aaaaaaa"), 4: list("a")}
    seqs = sequences_of(spark, table)
    assert rows(build_index(seqs, limit=5)) == rows(build_index(seqs))
    assert seen == [1, 3]


def test_whole_chain_on_frames(spark, one_partition):
    rng = random.Random(4)
    seqs = sequences_of(spark, {1: [[round(rng.random(), 2)] for _ in range(12)]}, "frame")
    options = {"kind": "variable", "threshold": 0.2, "method": "complete"}
    assert rows(build_index(seqs, limit=0, **options)) == rows(build_index(seqs, **options))


def test_null_symbols_and_functions_as_metrics(spark, one_partition):
    seqs = sequences_of(spark, {1: ["a", None, "a", None, "a"]})
    long = rows(build_index(seqs, limit=0))
    assert long == rows(build_index(seqs)) and len(long) == 6
    rng = random.Random(6)
    frames = sequences_of(spark, {1: [[rng.random(), rng.random(), rng.random()] for _ in range(6)]}, "frame")

    def city(x, others):
        return abs(others - x).sum(axis=1)

    for metric, threshold in ((city, 0.6), ("cosine", 0.05)):
        options = {"kind": "variable", "threshold": threshold, "metric": metric}
        assert rows(build_index(frames, limit=0, **options)) == rows(build_index(frames, **options))


def test_saved_index_can_be_built_on(spark, tmp_path):
    from seqloom.operators.automaton import read_index, save_index
    from seqloom.operators.matching import reverse_index

    rng = random.Random(2)
    frames = sequences_of(spark, {1: [[rng.random(), rng.random()] for _ in range(9)]}, "frame")
    for i, threshold in enumerate((0.3, spark.createDataFrame([(1, 0.4)], "seq_id long, threshold double"))):
        index = build_index(frames, "variable", threshold, "cityblock", "complete")
        save_index(index, str(tmp_path / f"ix{i}"))
        back = read_index(spark, str(tmp_path / f"ix{i}"))
        assert rows(back) == rows(index) and back.params[2:] == ("cityblock", "complete")
        assert rows(reverse_index(back, back.sources)) == rows(reverse_index(index, frames))


def test_one_linking_step_for_many_readers(spark):
    from seqloom.operators import similarity

    index = build_index(sequences_of(spark, {1: list("abbcabcdabc")}))
    plan = similarity.transition(index, "trn")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_few_rounds_for_doubled_and_periodic_texts(spark, monkeypatch, one_partition):
    rng = random.Random(1)
    half = [rng.choice("abcd") for _ in range(1000)]
    walks, inner = [], rounds._walk
    monkeypatch.setattr(rounds, "_walk", lambda *args: walks.append(1) or inner(*args))
    seqs = sequences_of(spark, {1: half + half, 2: list("abcab") * 400})
    long = rows(build_index(seqs, limit=0))
    assert long == rows(build_index(seqs)) and len(walks) < 12


def test_longest_earlier_repeats_are_repeats(spark, one_partition):
    from seqloom.operators.earlier import longest_earlier

    rng = random.Random(5)
    half = [rng.choice("abc") for _ in range(40)]
    table = {1: half + list("zz") + half, 2: list("abcab") * 12, 3: list("aaaaaaa"), 4: list("abcdefg"), 5: ["a"]}
    seqs = sequences_of(spark, table)
    items = rounds._items(seqs, ("seq_id",), "symbolic", 0.0)
    got = {}
    for r in longest_earlier(items, ("seq_id",), 82).collect():
        got.setdefault(r.seq_id, {})[r.i] = (r.end, r.len)
    for s, x in table.items():
        assert sorted(got[s]) == list(range(1, len(x) + 1))
        for i, (end, n) in got[s].items():
            assert 0 <= n <= end < i and x[i - n : i] == x[end - n : end]
    assert all(got[1][42 + k] == (k, k) for k in range(5, 41))
    assert all(got[2][i] == (i - 5, i - 5) for i in range(6, 61))
    assert all(got[3][i] == (i - 1, i - 1) for i in range(1, 8))
    assert set(got[4].values()) == {(0, 0)}
