"""Sharding by a minimax contiguous partition, in DataFrame operations only.

Equal texts form atomic groups, ordered by the digest of their text.  Documents are dealt
out in that order, the ends of the groups in running bytes are written as a narrow sorted
table, and a search finds the smallest capacity with which a greedy walk needs no more
than the given shards.  A greedy step is a lookup, the largest group end not beyond a
point, so one small aggregate over the table answers it for a whole ladder of capacities;
each round narrows the capacity by the size of the ladder.  Cuts lie on group ends, so a
document's shard follows from its running start alone and no group is ever gathered: a
hot group is split over slices and still lands in one shard.

A null text has no bytes and goes with the empty texts.  Repeated rows and null ids are
documents of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .columns import drop_shuffles
from .ordering import running, sliced

LADDER = 255  # capacities tried at once: eight halvings of the interval per round


def shard(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, size, text_crc32, shard, slot`` for every document."""
    drop_shuffles(docs.sparkSession)
    plain = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(plain) + 1).cast("long").alias("size"),
        F.crc32(F.encode(plain, "UTF-8")).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(plain, 256)).alias("digest"),
    )
    order = ["digest", "doc_id"]
    placed = cut(running(sliced(sized, *order), order, start=F.col("size"), rank=F.lit(1)))
    cuts = minimax_cuts(_group_ends(placed), shards)
    number = sum((F.when(F.col("start") >= c, 1).otherwise(0) for c, _ in cuts), F.lit(0))
    first = F.lit(0)
    for c, rank in cuts:
        first = F.when(F.col("start") >= c, F.lit(rank)).otherwise(first)
    return placed.select(
        "doc_id", "size", "text_crc32", number.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot")
    )


def _group_ends(placed: DataFrame) -> DataFrame:
    """``bytes, rank, size`` after each group: running bytes and documents, and its own bytes."""
    groups = placed.groupBy("digest").agg(
        F.max(F.col("start") + F.col("size")).alias("bytes"),
        (F.max("rank") + 1).alias("rank"),
        F.sum("size").alias("size"),
    )
    return cut(groups.select("bytes", "rank", "size").repartitionByRange("bytes").sortWithinPartitions("bytes"))


def minimax_cuts(ends: DataFrame, shards: int) -> list[tuple[int, int]]:
    """``(bytes, documents)`` before each shard but the first."""
    total, largest = ends.agg(F.max("bytes"), F.max("size")).first()
    if total is None:
        return []
    low = max(-(-total // shards), largest)  # no capacity below it can do
    high = low + largest  # a greedy walk closes a shard less than one group short, so this one does
    tried, best = [low], None
    while low < high or best is None:
        for capacity, cuts in zip(tried, _walks(ends, tried, shards, total, largest)):
            if cuts[-1][0] >= total:
                high, best = capacity, cuts
                break
            low = capacity + 1
        tried = [*range(low, high, max(1, (high - low) // LADDER)), high]
    return [c for c in best[:-1] if c[0] < total]


def _walks(ends: DataFrame, capacities: list[int], shards: int, total: int, largest: int) -> list[list]:
    """The greedy walk for each capacity: bytes and documents after each of its shards."""
    walks = [[(0, 0)] for _ in capacities]
    for _ in range(shards):
        points = [min(w[-1][0] + c, total) for w, c in zip(walks, capacities)]
        found = _reach(ends, points, largest)
        for w, p in zip(walks, points):
            w.append(found[p])
    return [w[1:] for w in walks]


def _reach(ends: DataFrame, points: list[int], largest: int) -> dict[int, tuple[int, int]]:
    """The last group end not beyond each point; it lies less than one group below."""
    ladder = sorted(set(points))
    rungs = F.lit(ladder).cast("array<bigint>")
    near = ends.where((F.col("bytes") <= ladder[-1]) & (F.col("bytes") > ladder[0] - largest))
    rung = near.select("bytes", "rank", F.size(F.filter(rungs, lambda p: p < F.col("bytes"))).alias("rung"))
    tops = rung.groupBy("rung").agg(F.max(F.struct("bytes", "rank")).alias("top")).collect()  # a row per rung
    top = {r["rung"]: (r["top"]["bytes"], r["top"]["rank"]) for r in tops}
    found, last = {}, (0, 0)
    for i, p in enumerate(ladder):
        last = top.get(i, last)
        found[p] = last
    return found
