"""Longest earlier repeats of long symbol sequences, by names of doubling length.

The name of the last ``2**r`` items at a position is the first position that ends with the
same items, so a level follows from pairs of names of the level before by one grouping, and
positions whose items never repeat leave the tables.  The longest repeated level of a
position puts it on a diagonal (its distance to the earlier copy).  Neighbours on one
diagonal are one run, which the levels then extend at both ends as far as items agree.
Of all runs over a position the one that starts first is its longest repeat.

Only a run's first copy is followed, so a length may fall short of the longest one; the
rounds that start from this table settle that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scan import running
from ..session import cut


def names(items: DataFrame, by, longest: int) -> list[DataFrame]:
    """Levels ``i, name`` for the last 1, 2, 4, ... items; only those that occur twice."""
    levels = [_repeated(items.select(*by, "i", F.col("x").alias("a"), F.lit(0).alias("b")), by)]
    while 2 ** len(levels) < longest:
        half = 2 ** (len(levels) - 1)
        near = levels[-1].select(*by, "i", F.col("name").alias("a"))
        far = levels[-1].select(*by, (F.col("i") + half).alias("i"), F.col("name").alias("b"))
        level = _repeated(near.join(far, [*by, "i"]), by)
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def _repeated(pairs: DataFrame, by) -> DataFrame:
    first = pairs.groupBy(*by, "a", "b").agg(F.min("i").alias("name"), F.count(F.lit(1)).alias("n"))
    return cut(pairs.join(first.where("n > 1").drop("n"), [*by, "a", "b"]).select(*by, "i", "name"))


def runs(items: DataFrame, by, longest: int) -> DataFrame:
    """Stretches ``start, end`` whose items all equal those ``d`` positions before."""
    by = list(by)
    levels = names(items, by, longest)
    seen = [level.where("name < i").withColumn("size", F.lit(2**r)) for r, level in enumerate(levels)]
    best = reduce(DataFrame.unionByName, seen).groupBy(*by, "i").agg(F.max(F.struct("size", "name")).alias("at"))
    best = cut(best.select(*by, "i", (F.col("i") - F.col("at.name")).alias("d"), (F.col("i") - F.col("at.size") + 1).alias("start")))
    before = best.select(*by, (F.col("i") + 1).alias("i"), F.col("d").alias("d_before"))
    opens = F.when(F.col("d_before").isNull() | (F.col("d_before") != F.col("d")), F.col("i"))
    owned = running(best.join(before, [*by, "i"], "left"), by, "i", longest, maxes={"h": opens})
    found = owned.groupBy(*by, "h").agg(F.max("d").alias("d"), F.min("start").alias("start"), F.max("i").alias("end"))
    return _extended(cut(found), levels, by)


def _extended(found: DataFrame, levels: list[DataFrame], by) -> DataFrame:
    """The runs as far as their items agree at both ends, by descending powers of two."""
    sides = F.explode(F.array(F.struct(F.lit(-1).alias("side"), (F.col("start") - 1).alias("p")), F.struct(F.lit(1).alias("side"), F.col("end").alias("p"))))
    ends = found.select(*by, "h", "d", sides.alias("s"), F.lit(0).alias("m")).select(*by, "h", "d", "s.*", "m")
    for r in range(len(levels) - 1, -1, -1):
        step = 2**r
        place = F.when(F.col("side") < 0, F.col("p") - F.col("m")).otherwise(F.col("p") + F.col("m") + step)
        here = levels[r].withColumnsRenamed({"i": "u", "name": "at_u"})
        there = levels[r].withColumnsRenamed({"i": "v", "name": "at_v"})
        asked = ends.withColumn("u", place).withColumn("v", F.col("u") - F.col("d"))
        met = asked.join(here, [*by, "u"], "left").join(there, [*by, "v"], "left")
        moved = F.col("m") + F.when(F.col("at_u") == F.col("at_v"), step).otherwise(0)
        ends = cut(met.select(*by, "h", "d", "side", "p", moved.alias("m")))
    reach = F.col("p") + F.col("side") * F.col("m")
    whole = ends.groupBy(*by, "h", "d").agg(
        (F.min(F.when(F.col("side") < 0, reach)) + 1).alias("start"), F.max(F.when(F.col("side") > 0, reach)).alias("end")
    )
    return whole.drop("h")


def longest_earlier(items: DataFrame, by, longest: int) -> DataFrame:
    """``i, end, len`` for every item: the repeat that ends there and where its earlier copy ends."""
    by = list(by)
    stop = runs(items, by, longest).groupBy(*by, F.col("end").alias("i")).agg(
        F.max(F.struct((-F.col("start")).alias("start"), "d")).alias("run")
    )
    # the run that starts first among those that end here or later
    back = items.select(*by, "i").join(stop, [*by, "i"], "left").withColumn("left", longest - F.col("i"))
    over = running(back, by, "left", longest, maxes={"over": F.col("run")})
    start = -F.col("over.start")
    inside = start <= F.col("i")
    return over.select(
        *by, "i", F.when(inside, F.col("i") - F.col("over.d")).otherwise(0).alias("end"),
        F.when(inside, F.col("i") - start + 1).otherwise(0).alias("len"),
    )
