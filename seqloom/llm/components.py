"""Connected components of links by rounds of joins.

Each round moves every node's links to the smallest node it knows (large star, then small
star), so components shrink to stars in a logarithmic number of rounds.  Rounds are
written tables in the shared folder; only the count of moved links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the smallest node names it."""
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = cut(ordered.where("a <> b").distinct())
    for _ in range(rounds):
        after = cut(_small_star(_large_star(stars)))
        if _same(stars, after):
            break
        stars = after
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(stars.selectExpr("b AS node", "b AS component")).distinct()


def _large_star(stars: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to its smallest neighbour or itself."""
    near = stars.selectExpr("a AS u", "b AS v").union(stars.selectExpr("b AS u", "a AS v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Link the smaller neighbours of every node, and itself, to the smallest of them."""
    least = stars.groupBy("a").agg(F.min("b").alias("m"))
    moved = stars.join(least, "a").select("a", "b", "m")
    links = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return links.where("a <> b").distinct()


def _same(before: DataFrame, after: DataFrame) -> bool:
    """Equal sets of links, by count and two sums of hashes."""
    marks = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("long"))]
    return before.agg(*marks).first() == after.agg(*marks).first()
