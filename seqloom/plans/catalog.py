"""Registered queries: each runs an operator over whole tables, most with SQL to check it.

``run`` builds the Spark result and ``sql`` derives the same rows in DuckDB from the base
tables.  Both sides list their integer, real and text columns once, so names and types
agree; reals are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, run, ctes: str = "", body: str | None = None, ints=(), reals=(), texts=()):
    """Add a query; ``ctes`` and ``body`` are its SQL, with the output columns given once."""

    def tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.select(
            *[F.col(c).cast("long").alias(c) for c in ints],
            *[F.round(F.col(c).cast("double"), 6).alias(c) for c in reals],
            *[F.col(c).cast("string").alias(c) for c in texts],
        )

    sql = None
    if body is not None:
        cols = [f'"{c}"::BIGINT AS "{c}"' for c in ints]
        cols += [f'round("{c}"::DOUBLE, 6) + 0.0 AS "{c}"' for c in reals]
        cols += [f'"{c}"::VARCHAR AS "{c}"' for c in texts]
        head = f"WITH RECURSIVE {ctes}\n" if ctes else ""
        sql = f"{head}SELECT {', '.join(cols)} FROM (\n{body}\n)"
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = Query(tidy, sql)


def load() -> dict[str, Query]:
    from . import (  # noqa: F401
        index_queries,
        matching_queries,
        segment_queries,
        stream_queries,
        vector_queries,
    )

    return QUERIES
