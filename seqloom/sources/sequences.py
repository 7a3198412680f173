"""Sequences out of tables.

A sequence frame has the columns ``seq_id``, ``ord`` (a struct of the ordering
columns) and ``item`` (a symbol, or an ``ARRAY<DOUBLE>`` frame).  Only these columns
leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scan import BLOCK


def symbols(df: DataFrame, seq, order: list[str], item) -> DataFrame:
    """Symbol sequences: ``item`` is any column whose values compare by equality.

    Rows that the order columns leave tied are ordered by their items.  For tuple-valued
    items pass the component to compare by, e.g. ``F.col("pair._1")``.
    """
    return df.select(_col(seq).alias("seq_id"), F.struct(*order).alias("ord"), _col(item).alias("item"))


def frames(df: DataFrame, seq, order: list[str], vec) -> DataFrame:
    """Feature sequences; a scalar column becomes a one-dimensional frame."""
    c = _col(vec)
    if isinstance(df.select(c).schema[0].dataType, T.ArrayType):
        c = c.cast("array<double>")
    else:
        c = F.array(c.cast("double"))
    return symbols(df, seq, order, c)


def reverse(seqs: DataFrame, longest: int | None = None) -> DataFrame:
    """The same sequences read backwards (over positions, so numbering comes first)."""
    return number(seqs, longest).select("seq_id", F.struct((-F.col("pos")).alias("pos")).alias("ord"), "item")


def meetings(seqs: DataFrame, ahead=(1,)) -> DataFrame:
    """Pairs ``obs_id, seq_id``: every sequence and those ``ahead`` of it in the order of ids, in a circle."""
    line = W.orderBy("seq_id")  # one row per sequence
    ranked = seqs.select("seq_id").distinct().withColumn("r", F.row_number().over(line) - 1)
    shift = F.explode(F.array(*[F.lit(a) for a in ahead])).alias("a")
    n = F.count(F.lit(1)).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    asked = ranked.withColumn("n", n).select(F.col("seq_id").alias("obs_id"), "r", "n", shift)
    asked = asked.select("obs_id", F.pmod(F.col("r") + F.col("a"), F.col("n")).cast("int").alias("r"))
    return asked.join(ranked, "r").select("obs_id", "seq_id")


def lengths(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one partition, over the session's shuffle partitions.

    The explicit count keeps adaptive execution from merging the partitions: their
    sequences are small in bytes but each costs a walk in Python.  A following
    ``groupBy`` on the same keys needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out over the shuffle partitions by a hash of the keys, for Python-heavy steps.

    Hashing once more keeps this apart from a partitioning by the keys themselves, which
    adaptive execution may have merged into few partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, F.xxhash64(*keys))


def pack(seqs: DataFrame, *keys: str) -> DataFrame:
    """One row per bounded sequence with its items in order."""
    packed = together(seqs, "seq_id", *keys).groupBy("seq_id", *keys).agg(
        F.sort_array(F.collect_list(F.struct("ord", "item"))).alias("packed")
    )
    return packed.select("seq_id", *keys, F.col("packed.item").alias("items"))


RANGES = 512  # slices of the order key used to number long sequences


def number(seqs: DataFrame, longest: int | None = None) -> DataFrame:
    """Dense positions ``pos`` = 1..N inside every sequence.

    A plain ``row_number`` sorts a whole sequence in one task and serves only when
    ``longest`` is known to be small.  Otherwise the rows are ranked inside slices of the
    first order column and every slice starts after the counts of the earlier ones, so
    one very long sequence is spread over the slices.
    """
    if longest is not None and longest <= BLOCK:
        return seqs.selectExpr(
            "seq_id", "row_number() OVER (PARTITION BY seq_id ORDER BY ord, item) AS pos", "item"
        )
    slices = _slices(seqs)
    cut_at = F.lit(0) if not slices else sum(
        (F.when(_first(seqs) > F.lit(b), 1).otherwise(0) for b in slices), F.lit(0)
    )
    cut = seqs.withColumn("slice", cut_at)
    offset = (
        cut.groupBy("seq_id", "slice").count()
        .selectExpr(
            "seq_id", "slice",
            "sum(count) OVER (PARTITION BY seq_id ORDER BY slice) - count AS before",
        )
    )
    ranked = cut.selectExpr(
        "*", "row_number() OVER (PARTITION BY seq_id, slice ORDER BY ord, item) AS in_slice"
    )
    return ranked.join(offset, ["seq_id", "slice"]).select(
        "seq_id", (F.col("before") + F.col("in_slice")).cast("int").alias("pos"), "item"
    )


def _first(seqs: DataFrame) -> Column:
    name = seqs.schema["ord"].dataType[0].name
    kind = seqs.schema["ord"].dataType[0].dataType
    c = F.col(f"ord.{name}")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    return c


def _slices(seqs: DataFrame) -> list:
    """At most ``RANGES`` cut points of the order key; none for one-slice inputs."""
    if not isinstance(seqs.select(_first(seqs)).schema[0].dataType, T.NumericType):
        return []
    parts = seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    n = min(int(parts), RANGES)
    probs = [i / n for i in range(1, n)]
    if not probs:
        return []
    row = seqs.select(F.percentile_approx(_first(seqs), probs, 10000)).first()
    return sorted(set(row[0] or []))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types per user, in time order."""
    return symbols(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values per user, in time order, as one-dimensional frames."""
    return frames(events(spark, sf_dir), "user_id", ["ts", "event_id"], "value")


def embedding_frames(spark: SparkSession, sf_dir: str, table: DataFrame | None = None) -> DataFrame:
    """Embedding vectors per label, in id order; ``table`` may be a stream of them."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet") if table is None else table
    return frames(table, F.col("label").cast("long"), ["vec_id"], "embedding")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
