import hashlib
import math
import random
import zlib

import pytest

from corpus import awkward, frame, prose
from seqloom.llm import sharding


def greedy(sizes, capacity):
    shards, held = 1, 0
    for s in sizes:
        if s > capacity:
            return math.inf  # no number of shards will do
        if held + s > capacity:
            shards, held = shards + 1, 0
        held += s
    return shards


def cases():
    r = random.Random(4)
    mixed = [(i, prose(r.randrange(40), r.randrange(1, 60))) for i in range(150)]
    hot = mixed + [(1000 + i, "one hot text " * 30) for i in range(120)]
    return {"awkward": awkward(), "mixed": mixed, "hot": hot, "few": [(1, "a"), (2, "bb")], "none": []}


@pytest.mark.parametrize("name", cases())
def test_shards(spark, name):
    rows = cases()[name]
    got = sharding.shard(frame(spark, rows), 8).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(zlib.crc32((t or "").encode()), (t or "").encode())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1) for i, t in rows
    )
    held, shard_of = {}, {}
    for r in got:
        held.setdefault(r.shard, []).append((r.slot, r["size"]))
        assert shard_of.setdefault(r.text_crc32, r.shard) == r.shard  # equal texts stay together
        assert r["size"] == len(texts[r.text_crc32]) + 1
    for slots in held.values():
        assert sorted(s for s, _ in slots) == list(range(len(slots)))
    assert set(held) <= set(range(8))
    groups = {}
    for _, t in rows:
        b = (t or "").encode()
        groups[b] = groups.get(b, 0) + len(b) + 1
    sizes = [s for _, s in sorted(groups.items(), key=lambda x: hashlib.sha256(x[0]).digest())]
    if sizes:
        best = max(sum(s for _, s in slots) for slots in held.values())
        assert greedy(sizes, best) <= 8 and greedy(sizes, best - 1) > 8  # no smaller capacity does
