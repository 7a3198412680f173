import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpus import awkward, frame
from seqloom.llm import packing


def file_ids(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("length", [1024, 64])
def test_every_id_lies_in_one_piece(spark, length):
    rows = awkward()
    got = packing.pack(frame(spark, rows), length, with_ids=True).collect()
    texts = {i: t for i, t in rows}
    docs, sequences = {}, {}
    for r in got:
        assert r.length == len(r.ids) <= length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        docs.setdefault(r.doc_id, {}).setdefault(r.start, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert docs.keys() == texts.keys()
    for i, starts in docs.items():
        whole = [x for s in sorted(starts) for x in starts[s][0].ids]
        assert whole == [*file_ids(texts[i]), 0]
        copies = sum(j == i for j, _ in rows)
        assert all(len(p) == copies and p[0].doc_tokens == len(whole) for p in starts.values())
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length


def test_added_tokens_have_the_ids_of_the_file():
    text = "a <|endoftext|> b"
    assert packing.encoder(packing.VOCABULARY)(text) == file_ids(text) and file_ids(text).count(50256) == 1


def best_sum(counts, capacity):
    items = [n for n, c in counts.items() for _ in range(c)]
    longest = max(items)
    items.remove(longest)
    sums = {sum(x) for k in range(len(items) + 1) for x in itertools.combinations(items, k)}
    return longest + max(s for s in sums if s + longest <= capacity)


def test_fill_is_the_closest_sum():
    r = random.Random(7)
    for _ in range(200):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(4)}
        capacity = r.randrange(30, 60)
        used = packing.fill(counts, capacity)
        assert sum(n * k for n, k in used.items()) == best_sum(counts, capacity)
        assert all(k <= counts[n] for n, k in used.items())


def test_plan_places_all_with_little_padding():
    r = random.Random(8)
    counts = {n: r.randrange(20, 30) + 40_000 // (n + 50) for n in range(1, 1025)}
    made = packing.plan(counts)
    placed = {}
    for _, used, times in made:
        for n, k in used.items():
            placed[n] = placed.get(n, 0) + k * times
    assert placed == counts
    sequences = sum(times for _, _, times in made)
    assert sum(n * c for n, c in counts.items()) > 0.999 * 1024 * sequences


def test_empty(spark):
    assert packing.pack(frame(spark, [])).count() == 0
