"""Following a successor function from start points without a step-by-step loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def orbit(starts: DataFrame, successor: DataFrame, by, longest: int) -> DataFrame:
    """All places ``j`` reached from ``starts`` by any number of steps ``j -> to``.

    Pointer doubling: the joins grow with the logarithm of the number of steps.
    """
    by = list(by)
    jump, span = successor.select(*by, "j", "to"), 1
    reached = starts.select(*by, "j")
    while span <= longest:
        landed = reached.join(jump, [*by, "j"]).select(*by, F.col("to").alias("j"))
        reached = cut(reached.unionByName(landed).distinct())
        onward = jump.select(*by, F.col("j").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(onward, [*by, "to"]).select(*by, "j", F.col("far").alias("to")))
        span *= 2
        if jump.isEmpty():
            break
    return reached


def nearest_larger_before(values: DataFrame, by, reach: int) -> DataFrame:
    """For every place ``i`` the last earlier place with a larger ``v``, within ``reach``.

    Adds ``before``; places further than ``reach`` below ``i`` mean that there is none.
    Window maxima of doubling widths are built by joins and then descended.
    """
    by = list(by)
    tops = [cut(values.select(*by, "i", F.col("v").alias("top")))]
    while 2 ** len(tops) <= reach:
        half = 2 ** (len(tops) - 1)
        left = tops[-1].select(*by, (F.col("i") + half).alias("i"), F.col("top").alias("earlier"))
        wide = tops[-1].join(left, [*by, "i"], "left")
        tops.append(cut(wide.select(*by, "i", F.greatest("top", F.coalesce("earlier", "top")).alias("top"))))
    found = values.withColumn("before", F.col("i") - 1)
    for level in range(len(tops) - 1, -1, -1):
        top = tops[level].withColumnRenamed("i", "before")
        skip = F.when(F.col("top") <= F.col("v"), 2**level).otherwise(0)
        found = found.join(top, [*by, "before"], "left").withColumn("before", F.col("before") - skip).drop("top")
        found = cut(found)
    return found
