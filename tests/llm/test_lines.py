"""Line dedup against a plain count of whole line keys."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpus import awkward, frame
from seqloom.llm import lines

BLANK = " \t\n\x0b\x0c\r"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def keyed(line):
    return line.strip(BLANK).translate(UPPER)


def expected(rows, min_docs, min_chars, keep):
    """Rows ``doc_id, n_lines, n_dropped, kept`` by counting every key."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    docs, first = {}, {}
    for row, (i, ls) in enumerate(split):
        for at, line in enumerate(ls):
            docs.setdefault(keyed(line), set()).add(row)
            spot = (i is None, i or 0, at)
            first[keyed(line)] = min(first.get(keyed(line), spot), spot)
    out = []
    for i, ls in split:
        kept = []
        for at, line in enumerate(ls):
            k = keyed(line)
            gone = len(k) >= min_chars and len(docs[k]) >= min_docs
            if gone and keep == "first" and first[k] == (i is None, i or 0, at):
                gone = False
            if not gone:
                kept.append(line)
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def corpus_rows():
    r = random.Random(11)
    stock = [f"Stock LINE {i} é漢" for i in range(40)]
    rows = []
    for i in range(300):
        own = [f"only {i} {j}" for j in range(r.randrange(6))]
        own += [r.choice([" ", "\t", "", "\r"]) + r.choice([s, s.upper(), s.lower()]) + r.choice(["", " ", "\x0b"]) for s in r.sample(stock, r.randrange(4))]
        own += ["", "  ", "É x", "é x", "one hot line"][: r.randrange(6)]
        if i % 3 == 0:
            own.append("One hot LINE")
        r.shuffle(own)
        rows.append((i, "\n".join(own)))
    return rows + [(900, None), (901, ""), (902, "\n\n"), (903, "one hot line\n" * 3000)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 9)])
def test_lines_against_counts(spark, keep, min_docs, min_chars):
    rows = corpus_rows()
    got = lines.dedup(frame(spark, rows).repartition(5), min_docs, min_chars, keep).collect()
    assert sorted(map(tuple, got)) == sorted(expected(rows, min_docs, min_chars, keep))


@pytest.mark.parametrize("sent", [1 << 29, 1 << 10])
def test_many_segments_and_folded_filters(spark, monkeypatch, sent):
    """Folded filters suspect nearly every line and the result is the same."""
    monkeypatch.setattr(lines, "KEYS", 40)
    monkeypatch.setattr(lines, "SENT", sent)
    rows = corpus_rows()
    got = lines.dedup(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(expected(rows, 10, 1, "none"))


def test_odd_rows(spark):
    rows = awkward()

    def order(r):
        return (r[0] is None, r[0] or 0, *r[1:])

    got = lines.dedup(frame(spark, rows), 2).collect()
    assert sorted(map(tuple, got), key=order) == sorted(expected(rows, 2, 1, "none"), key=order)
    assert lines.dedup(frame(spark, [])).collect() == []
    nothing = spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, lines.dedup(nothing).collect()), key=order) == [(1, 1, 0, ""), (None, 1, 0, "")]


def test_repeated_rows_keep_the_first_line_alike(spark):
    got = lines.dedup(frame(spark, [(1, "a\nb"), (1, "a\nb"), (2, "a")]), 2, keep="first").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0, "a\nb"), (1, 2, 0, "a\nb"), (2, 1, 1, "")]


def test_filters_miss_nothing_and_suspect_little():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**63, 40_000).astype(np.uint64)
    assert (np.diff(lines.segment(np.sort(h), 4)) >= 0).all()
    low = h.astype("<u4")
    chunks = pa.table({"seen": [low[:30_000].tobytes(), low[25_000:].tobytes()], "again": [low[:10].tobytes(), b""]})
    bits = lines.repeats_of_segment(lines.TWICE)((pa.scalar(0),), chunks)["bits"][0].as_py()
    twice = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
    found = twice[lines.places(low, lines.TWICE)].all(1)
    assert found[25_000:30_000].all() and found[:10].all() and found.sum() < 5_010 + 100
