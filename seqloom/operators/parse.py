"""Code words of the automaton's parse, and their non-overlapping form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Index


def encode(index: Index) -> DataFrame:
    """One row per word: it ends at ``end`` and copies ``len`` items from ``pos``.

    A new symbol is a word of length 0 whose ``pos`` is its own position.  Every state
    knows its word, so this is a filter on the state table.
    """
    size = F.col("state") - F.col("word")
    return index.frames.where("state = word_end").select(
        *index.keys,
        "word",
        F.col("state").alias("end"),
        F.when(F.col("lrs") == 0, 0).otherwise(size).alias("len"),
        F.when(F.col("lrs") == 0, F.col("state")).otherwise(F.col("sfx") - size + 1).alias("pos"),
        "sfx",
        "lrs",
    )


def segment(index: Index) -> DataFrame:
    """Words whose source may not run into the copy: such words are cut in two.

    ``at`` is the position before the piece and ``piece`` its order inside the word.
    The first piece stops where the source would meet the copy; the second is parsed
    once from there, or is a new item when nothing can be copied.
    """
    keys = list(index.keys)
    words = encode(index).withColumn("split", F.col("sfx") + F.col("lrs") > F.col("end"))
    whole = words.where("lrs = 0 OR NOT split")
    cut = words.where("lrs > 0 AND split").withColumn("cut", F.expr("word + end - sfx"))
    first = cut.select(*keys, "word", F.col("cut") - F.col("word"), "pos", _piece(0), F.col("word"))

    st = index.frames
    at_cut = st.select(*keys, F.col("state").alias("cut"), F.col("lrs").alias("lrs_cut"))
    inner = cut.select(*keys, "word", "end", "cut").join(at_cut, [*keys, "cut"], "left")
    rest = st.select(*keys, "state", F.col("word_end").alias("end"), F.col("lrs").alias("lrs_x"))
    stop = (
        inner.join(rest, [*keys, "end"])
        .groupBy(*keys, "word", "end", "cut")
        .agg(F.min(F.expr("IF(state > cut AND lrs_x - lrs_cut < state - cut, state, NULL)")).alias("x"))
        .withColumn("stop", F.expr("IF(cut >= end, cut, coalesce(x - 1, end))"))
    )
    at_stop = st.select(*keys, F.col("state").alias("stop"), F.col("sfx").alias("sfx_stop"))
    second = stop.join(at_stop, [*keys, "stop"], "left").selectExpr(
        *keys, "word",
        "IF(stop = cut, 0, stop - cut)",
        "IF(stop = cut, cut + 1, sfx_stop - stop + cut + 1)",
        "1", "cut",
    )
    names = [*keys, "word", "len", "pos", "piece", "at"]
    plain = whole.select(*keys, "word", "len", "pos", _piece(0), F.col("word").alias("at"))
    return plain.toDF(*names).union(first.toDF(*names)).union(second.toDF(*names))


def _piece(n: int) -> Column:
    return F.lit(n).alias("piece")
