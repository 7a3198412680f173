"""Repeated windows of words and bytes against a plain search."""

import random

import numpy as np
import pytest

from corpus import awkward, frame, prose, words
from seqloom.llm import repeats, substrings, suffixes

NO_ID = 1 << 62


def kept_of(units, gone):
    spans, kept = [], []
    for i, (u, g) in enumerate(zip(units, gone)):
        if g:
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        else:
            kept.append(u)
    return spans, kept


def plain(rows, window, units_of, within):
    """Removed spans and kept units per row, by a dictionary of first places."""
    first = {}
    docs = [(NO_ID if i is None else i, units_of(t)) for i, t in rows]
    for d, u in docs:
        for s in range(len(u) - window + 1):
            place = (d, s) if within else (d, 0)
            key = tuple(u[s : s + window])
            first[key] = min(first.get(key, place), place)
    out = []
    for d, u in docs:
        gone = [False] * len(u)
        for s in range(len(u) - window + 1):
            if first[tuple(u[s : s + window])] < ((d, s) if within else (d, 0)):
                gone[s : s + window] = [True] * window
        out.append(kept_of(u, gone))
    return out


def byte_units(text):
    return list((text or "").encode())


def shuffled(seed, n):
    """Documents pieced together from shared and own passages."""
    r = random.Random(seed)
    shared = [prose(100 + i, r.randrange(15, 90)) for i in range(12)]
    rows = []
    for i in range(n):
        parts = [r.choice(shared) if r.random() < 0.5 else prose(1000 * seed + i, r.randrange(5, 60)) for _ in range(r.randrange(1, 6))]
        rows.append((i * 3 % n, "".join(parts)))
    return rows


CASES = {
    "awkward": awkward(),
    "shuffled": shuffled(1, 60),
    "hot": [(i, prose(5, 60) + f" own{i} " + prose(6, 60)) for i in range(80)],
    "copies": [(i, prose(7, 200)) for i in range(30)],
    "runs": [(1, "a" * 300), (2, "ab" * 200), (3, "b" + "a" * 120), (4, "x " * 90), (5, "x y " * 60)],
    "none": [],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_equals_plain_search(spark, name, kind):
    rows = CASES[name]
    if kind == "words":
        search, compare, window, units = substrings.WORDS, substrings.edge_hashes, 20, words
    else:
        search, compare, window, units = suffixes.BYTES, suffixes.rank_pairs, 50, byte_units
    got = repeats.without_repeats(frame(spark, rows), search, compare, block=2_000).collect()  # many blocks
    want = []
    for (i, t), (spans, kept) in zip(rows, plain(rows, window, units, kind == "words")):
        text = " ".join(kept).encode() if kind == "words" else bytes(kept)
        want.append((i is None, i or 0, len(units(t)), sum(b - a for a, b in spans), spans, text))
    own = [(r.doc_id is None, r.doc_id or 0, r.n_units, r.n_removed, [[s.start, s.end] for s in r.spans], bytes(r.kept)) for r in got]
    assert sorted(own) == sorted(want)


def test_chunks_do_not_matter(monkeypatch):
    texts = [t.encode() for _, t in shuffled(2, 20)]
    monkeypatch.setattr(repeats, "CHUNK", 1 << 20)
    units = repeats.Units.of(texts, False)
    whole = repeats.stretches(units, 50, 20)
    monkeypatch.setattr(repeats, "CHUNK", 137)
    parts = repeats.stretches(units, 50, 20)

    def windows(s):
        return {(a + i, g) for a, n, g in zip(s.start.tolist(), s.count.tolist(), s.gram.tolist()) for i in range(n)}

    assert windows(whole) == windows(parts)
    starts = {s for s, _ in windows(whole)}
    ends = np.cumsum([len(t) for t in texts])
    assert starts == {s for a, b in zip([0, *ends], ends) for s in range(a, b - 49)}


def test_grams_by_doubling():
    x = np.random.default_rng(0).integers(0, 4, 400, dtype=np.uint64)
    for k in (1, 2, 3, 8, 20, 31):
        h = repeats.gram_hashes(x, k)
        assert len(h) == 401 - k
        same = {}
        for i, v in enumerate(h.tolist()):
            assert same.setdefault(tuple(x[i : i + k].tolist()), v) == v
        assert len(set(h.tolist())) == len(same)


def test_texts_in_front_of_operators(spark):
    docs = frame(spark, [(1, "w%d " * 30 % tuple(range(30))), (2, "x " + "w%d " * 30 % tuple(range(30)))])
    first, second = substrings.dedup(docs).orderBy("doc_id").collect()
    assert (first.n_removed, second.n_removed, second.kept) == (0, 30, "x")
    first, second = suffixes.dedup(docs).orderBy("doc_id").collect()
    assert first.n_removed == 0 and bytes(second.kept) == b"x "
