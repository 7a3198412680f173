"""Hand-derived values of one short symbol sequence."""

import math

import pytest

from conftest import sequences_of
from seqloom.operators import motifs, parse, predict, rate, similarity
from seqloom.operators.automaton import build_index, read_index, save_index
from seqloom.operators.links import link_frames, link_symbols

ITEMS = list("abbcabcdabc")


@pytest.fixture(scope="module")
def seqs(spark):
    return sequences_of(spark, {1: ITEMS})


@pytest.fixture(scope="module")
def index(seqs):
    return build_index(seqs)


def test_links():
    got = link_symbols(ITEMS)
    assert got["sfx"] == [-1, 0, 0, 2, 0, 1, 2, 4, 0, 1, 2, 7]
    assert got["lrs"] == [0, 0, 0, 1, 0, 1, 2, 2, 0, 1, 2, 3]
    assert got["trn"] == [[1, 2, 4, 8], [2], [3, 4], [4], [5, 8], [6], [7], [8], [9], [10], [11], []]
    assert got["label"] == [-1, 0, 1, 1, 2, 0, 1, 2, 3, 0, 1, 2]


def test_symbols_are_frames_at_distance_one():
    codes = {c: float(i) for i, c in enumerate("abcd")}
    as_frames = link_frames([codes[c] for c in ITEMS], 0.5)
    assert {k: as_frames[k] for k in ("sfx", "lrs", "trn", "label")} == {
        k: link_symbols(ITEMS)[k] for k in ("sfx", "lrs", "trn", "label")
    }


def test_running_lengths(index):
    last = similarity.running_lengths(index).where("state = 11").first()
    assert (last.max_lrs, last.avg_lrs) == (3, 12 / 11)


def test_words(index):
    words = parse.encode(index).orderBy("end")
    assert [(r.len, r.pos, r.end) for r in words.collect()] == [
        (0, 1, 1), (0, 2, 2), (1, 2, 3), (0, 4, 4), (2, 1, 6), (1, 4, 7), (0, 8, 8), (3, 5, 11),
    ]
    cut = parse.segment(index).orderBy("word", "piece")
    assert [(r.len, r.pos) for r in cut.collect()] == [
        (0, 1), (0, 2), (1, 2), (0, 4), (2, 1), (1, 4), (0, 8), (3, 5),
    ]


def test_information_rate(index):
    got = [r.ir for r in rate.information_rate(index).orderBy("step").collect()]
    x = math.log2(3) - math.log2(5) / 2
    assert got == pytest.approx([0, 0, 0, 0, x, x, 0, 0, 1, 1, 1])
    with pytest.raises(ValueError):
        rate.information_rate(index, "none")


def test_transitions(index):
    def cells(method):
        rows = similarity.transition(index, method).collect()
        return {("abcd"[r["from"]], "abcd"[r["to"]]): r["prob"] for r in rows}

    seq = {("a", "b"): 1, ("b", "b"): 1 / 4, ("b", "c"): 3 / 4, ("c", "a"): 1 / 2, ("c", "d"): 1 / 2, ("d", "a"): 1}
    trn = {("a", "b"): 1, ("b", "b"): 1 / 5, ("b", "c"): 4 / 5, ("c", "a"): 1 / 3, ("c", "d"): 2 / 3, ("d", "a"): 1}
    assert cells("seq") == pytest.approx(seq)
    assert cells("trn") == pytest.approx(trn)


def test_same_cluster_cells(index):
    rows = {r.i: r for r in similarity.self_similarity(index).collect()}
    tile = {(r.i, r.j) for r in similarity.similarity_tile(index, (1, 11), (3, 9)).collect()}
    assert tile == {(i, j) for i in range(1, 12) for j in range(3, 10) if ITEMS[i - 1] == ITEMS[j - 1]}
    assert all(rows[i].row_sum == ITEMS.count(ITEMS[i - 1]) for i in rows)


def test_patterns(index):
    found = motifs.find_repeated_patterns(index).orderBy("pattern", ascending=False).collect()
    assert [(r.ends, r.len) for r in found] == [([11, 7], 3), ([10, 2, 6], 2), ([11, 7, 4], 2)]


def test_predict(spark, seqs):
    asked = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["x", "b"])], "seq_id long, ctx_id long, context array<string>")
    rows = predict.predict(seqs, asked).collect()
    got = {r.symbol: r.prob for r in rows if r.ctx_id == 0}
    assert got == {"a": 1 / 8, "b": 2 / 8, "c": 4 / 8, "d": 1 / 8}
    assert {r.used for r in rows if r.ctx_id == 0} == {2}
    assert {r.used for r in rows if r.ctx_id == 1} == {1}


def test_save_and_read(spark, index, tmp_path):
    save_index(index, str(tmp_path / "ix"))
    back = read_index(spark, str(tmp_path / "ix"))
    assert back.keys == index.keys and back.longest == 11
    assert sorted(map(tuple, back.states.select("state", "sfx").collect()), key=str) == sorted(
        map(tuple, index.states.select("state", "sfx").collect()), key=str
    )
