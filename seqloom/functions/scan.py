"""Running aggregates and neighbours that do not put a long sequence into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 100_000  # positions that one window task may hold


def running(df: DataFrame, keys, order: str, longest: int, sums=None, maxes=None, block: int = BLOCK):
    """Add running sums and maxima of the given columns along ``order`` within ``keys``.

    Up to ``block`` positions this is one window.  Beyond, every block of positions is
    aggregated on its own and then combined with the totals of the blocks before it.
    """
    aggs = [(n, c, F.sum, _plus) for n, c in (sums or {}).items()]
    aggs += [(n, c, F.max, _larger) for n, c in (maxes or {}).items()]
    if longest <= block:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[f(c).over(w).alias(n) for n, c, f, _ in aggs])
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    w = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select("*", *[f(c).over(w).alias(f"_in_{n}") for n, c, f, _ in aggs])
    totals = blocked.groupBy(*keys, "_block").agg(*[f(c).alias(n) for n, c, f, _ in aggs])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_block", *[f(n).over(before).alias(f"_pre_{n}") for n, _, f, _ in aggs])
    whole = [plus(F.col(f"_in_{n}"), F.col(f"_pre_{n}")).alias(n) for n, _, _, plus in aggs]
    return local.join(starts, [*keys, "_block"]).select(*df.columns, *whole)


def _plus(here: Column, before: Column) -> Column:
    return here + F.coalesce(before, F.lit(0))


def _larger(here: Column, before: Column) -> Column:
    return F.greatest(here, before)


def with_next(df: DataFrame, keys, order: str, longest: int, block: int = BLOCK, **cols) -> DataFrame:
    """Add columns of the row at ``order + 1``: a window, or a join on the position when long."""
    if longest <= block:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.select("*", *[F.lead(c).over(w).alias(n) for n, c in cols.items()])
    after = df.select(
        *keys, (F.col(order) - 1).alias(order), *[F.col(c).alias(n) for n, c in cols.items()]
    )
    return df.join(after, [*keys, order], "left")
