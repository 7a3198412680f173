"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

A fingerprint has 64 majority bits of the hashes of a text's shingles.  Distinct
fingerprints, not documents, are joined, so copies of a text cost nothing.  Two
fingerprints that differ in at most ``budget`` bits agree in one of ``budget + 1`` blocks of
bits; for every block the fingerprints are rotated so that the block comes first, and those
that share it lie under one node of the trie at that depth.  These nodes are dealt out
over the cluster.  A task walks pairs of nodes below together, bit by bit, adds up the
differing bits and drops a pair of nodes once they exceed the budget.  A node that holds
too many fingerprints for one task is first opened by a further byte and its pairs of
children within the budget are dealt out instead.  A task reports a spanning forest of the
links it finds, which keeps components whole without listing all pairs of a group.

Fingerprints without a word are zero and link like any other.  A null text has no words.
A null id takes part and is the smallest of its component only if all ids are null.
Repeated rows share their component; extra columns pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .columns import partitions, small_batches
from .components import components

SHINGLE, SEED = 4, 42
BUDGET = 4
NODE = 20_000  # fingerprints of a trie node that one task walks
CHUNK = 1 << 18  # pairs of nodes, and shingles, held at once
LEAF = 32  # pairs of fingerprints compared directly


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and blanks only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[size - 1 :] or [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))


def majority(hashes: np.ndarray) -> int:
    """Bit by bit, 1 where more than half the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    found = np.fromiter((majority(shingle_hashes(t)) for t in texts), np.uint64, len(texts))
    return pd.Series(found.view(np.int64))


def rotations(budget: int) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    edges = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def trie_links(codes: np.ndarray, lows: np.ndarray, highs: np.ndarray, depth, budget: int):
    """Pairs ``i < j`` of sorted ``codes`` within the budget, below the given nodes.

    A node is the range of codes with a common prefix of ``depth`` bits.  Pairs of nodes are
    walked together from the self-pairs of the given ones; each step opens one more bit.
    """
    stack = [(lows, highs, lows, highs, np.zeros(len(lows), np.int8), np.asarray(depth, np.int8))]
    while stack:
        a0, a1, b0, b1, err, deep = stack.pop()
        if len(a0) > CHUNK:
            half = len(a0) // 2
            stack += [tuple(x[:half] for x in (a0, a1, b0, b1, err, deep)), tuple(x[half:] for x in (a0, a1, b0, b1, err, deep))]
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (deep >= 64)
        if small.any():
            yield from _leaves(codes, a0[small], a1[small], b0[small], b1[small], budget)
            a0, a1, b0, b1, err, deep = (x[~small] for x in (a0, a1, b0, b1, err, deep))
        if not len(a0):
            continue
        am, bm = _middle(codes, a0, a1, deep), _middle(codes, b0, b1, deep)
        own, deep, more = (a0 == b0), deep + 1, err + 1
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, more)]
        parts = [(*p, deep, np.ones(len(a0), bool)) for p in parts] + [(am, a1, b0, bm, more, deep, ~own)]
        opened = [np.concatenate(x) for x in zip(*parts)]
        keep = opened[6] & (opened[0] < opened[1]) & (opened[2] < opened[3]) & (opened[4] <= budget)
        if keep.any():
            stack.append(tuple(x[keep] for x in opened[:6]))


def _middle(codes, lo, hi, depth):
    """Where the next bit turns to one in each range of sorted codes."""
    shift = (63 - depth).astype(np.uint64)
    prefix = codes[lo] >> shift | np.uint64(1)
    bound = prefix << shift
    lo, hi = lo.copy(), hi.copy()
    while True:  # a binary search in all ranges at once
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        less = open_ & (codes[np.minimum(mid, len(codes) - 1)] < bound)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)


def _leaves(codes, a0, a1, b0, b1, budget):
    """Compare the fingerprints of small pairs of nodes directly."""
    across = b1 - b0
    size = (a1 - a0) * across
    for at in range(0, len(size), max(1, CHUNK // LEAF)):
        s = slice(at, at + max(1, CHUNK // LEAF))
        n = size[s]
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = a0[s][row] + k // across[s][row], b0[s][row] + k % across[s][row]
        near = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
        yield i[near], j[near]


class Forest:
    """Sets of positions; ``add`` tells which of the links joined two sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _rotated(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    left = first.astype(np.uint64)
    return np.where(left == 0, codes, codes << left | codes >> (np.uint64(64) - np.maximum(left, np.uint64(1))))


def join_nodes(budget: int):
    """A task's nodes ``(first, width, lead, pair)`` with their fingerprints, joined."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        df = pd.concat(rows)
        first, fp = df["first"].to_numpy(), df["fp"].to_numpy().view(np.uint64)
        codes = _rotated(fp, first)
        group = df.groupby(["first", "lead", "pair"], sort=False).ngroup().to_numpy()
        order = np.lexsort((codes, group))
        group, codes, fp, width = group[order], codes[order], fp[order], df["width"].to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends = np.r_[starts[1:], len(group)]
        forest, out = Forest(len(codes)), []
        for i, j in trie_links(codes, starts, ends, width[starts], budget):
            out += [(fp[a], fp[b]) for a, b in zip(i.tolist(), j.tolist()) if forest.add(a, b)]
        found = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return join


def near_links(fps: DataFrame, budget: int = BUDGET, node: int = NODE) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that keep all components whole."""
    blocks = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(w).alias("width")) for a, w in rotations(budget)])
    placed = fps.select("fp", F.explode(blocks).alias("block")).select("fp", "block.*")
    lead = placed.withColumn("lead", F.expr("shiftrightunsigned(shiftleft(fp, first), 64 - width)"))
    child = F.expr("shiftrightunsigned(shiftleft(fp, first + width), 56)")  # the byte after the block
    lead = lead.withColumn("child", child.cast("int"))
    large = lead.groupBy("first", "lead").count().where(F.col("count") > node).select("first", "lead", F.lit(True).alias("large"))
    marked = lead.join(large, ["first", "lead"], "left")
    apart = F.filter(
        F.sequence(F.lit(0), F.lit(255)), lambda o: F.bit_count(o.bitwiseXOR(F.col("child"))) <= budget
    )
    pair = F.transform(apart, lambda o: F.least(o, F.col("child")) * 256 + F.greatest(o, F.col("child")))
    tasks = marked.withColumn("pair", F.explode(F.when(F.col("large"), pair).otherwise(F.array(F.lit(-1)))))
    tasks = tasks.select("first", "width", "lead", "pair", "fp")
    n = partitions(fps.sparkSession)
    dealt = tasks.repartition(n, "first", "lead", "pair")
    return dealt.mapInPandas(join_nodes(budget), "a long, b long").distinct()


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and its fingerprint ``fp`` for every document, written once."""
    small_batches(docs.sparkSession)
    return cut(docs.select(F.col(key).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", budget: int = BUDGET, node: int = NODE) -> DataFrame:
    """``doc_id, fp, component_id`` per document; the smallest id names its component."""
    marked = fingerprints(docs, text, key)
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = near_links(distinct, budget, node)
    found = components(links)
    named = found.join(distinct.withColumnRenamed("fp", "node"), "node")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    members = found.join(smallest, "component").select(F.col("node").alias("fp"), "component_id")
    labels = distinct.join(members, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")
