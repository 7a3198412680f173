import itertools
import random

import numpy as np
import pytest
import xxhash

from corpus import Sets, awkward, frame, prose, words
from seqloom.llm import simhash
from seqloom.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def rows_of(name):
    if name == "awkward":
        return awkward() + [(30, "ONE Two"), (31, "one two"), (32, "ÉCOLE x"), (33, "école x")]
    r = random.Random(5)
    base, rows = prose(1, 300).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"new{r.randrange(99)}"
        rows.append((1000 - i, " ".join(w)))
    return rows + [(i, prose(i, 200)) for i in range(1, 51)]


@pytest.mark.parametrize("node", [20_000, 5])
@pytest.mark.parametrize("name", ["awkward", "near"])
def test_components_equal_all_pairs(spark, name, node):
    rows = rows_of(name)
    got = simhash.near_duplicates(frame(spark, rows), node=node).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted((r.doc_id or -1, r.fp % (1 << 64)) for r in got) == sorted((i or -1, f) for i, f in fps)
    sets = Sets()
    for f, g in itertools.combinations({f for _, f in fps}, 2):
        if (f ^ g).bit_count() <= 4:
            sets.join(f, g)
    least = {}
    for i, f in fps:
        if i is not None:
            least[sets.root(f)] = min(least.get(sets.root(f), i), i)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == sorted((i or -1, least.get(sets.root(f), -1)) for i, f in fps)


@pytest.mark.parametrize("node", [20_000, 50])
def test_links_keep_components(spark, node):
    r = random.Random(9)
    centres = [r.getrandbits(64) for _ in range(30)]
    fps = set(centres)
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(r.randrange(1, 6)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    hot = 0xABCDEF  # many fingerprints that share whole blocks
    fps |= {hot | r.getrandbits(20) << 44 for _ in range(300)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    own, want = Sets(), Sets()
    for row in simhash.near_links(df, node=node).collect():
        a, b = row.a % (1 << 64), row.b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        own.join(a, b)
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            want.join(a, b)
    assert len({own.root(f) for f in fps}) == len({want.root(f) for f in fps})


def test_trie_finds_every_pair():
    rng = np.random.default_rng(2)
    codes = np.unique(np.r_[rng.integers(0, 1 << 12, 500).astype(np.uint64), rng.integers(0, 1 << 63, 50).astype(np.uint64)])
    one = np.zeros(1, np.int64)
    pairs = [(i, j) for a, b in simhash.trie_links(codes, one, one + len(codes), one.astype(np.int8), 4) for i, j in zip(a.tolist(), b.tolist())]
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 4}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 60)] + [(61, 62), (62, 61), (63, 63)]
    r = random.Random(1)
    r.shuffle(links)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(20, 60)]} | {61: 61, 62: 61}
    assert got == want


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
