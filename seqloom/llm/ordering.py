"""Positions in a total order without sorting in one task.

Rows are dealt out by ranges of the order and written once with their slice number, so the
slices stay as they are when an executor is lost.  Counts and sums of the slices (one row
each) then shift the running values inside every slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .columns import partitions


def sliced(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` as a written table with its rows' ``slice`` in the order of the columns."""
    n = partitions(df.sparkSession)
    return cut(df.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id()))


def running(slices: DataFrame, order: list, **sums: Column) -> DataFrame:
    """Running sums over all rows before each one, in the order of ``sliced``.

    ``sums`` names the new columns; ``order`` must break all ties the caller cares about.
    """
    per_slice = slices.groupBy("slice").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # one row per slice
    starts = per_slice.select("slice", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = W.partitionBy("slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = slices.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    shifted = ranked.join(starts, "slice").withColumns({k: (F.col(k) + F.col(f"_{k}")).cast("long") for k in sums})
    return shifted.drop(*[f"_{k}" for k in sums])
