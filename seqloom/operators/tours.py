"""Suffix trees as intervals: every state enters and leaves one walk around its tree.

A state is below another exactly when its interval lies inside the other's, so ancestry
takes two numbers per state instead of all pairs on the suffix chains.  Bounded sequences
are walked inside a task, many to a batch.  In longer ones the walk is a chain of events, each
knowing the next one; their numbers come from list ranking by pointer doubling, whose rounds
grow with the log of the number of states however deep the tree is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scan import running
from ..session import cut
from .automaton import LIMIT, Index

_TOUR = ("state", "enter", "leave", "chain")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in _TOUR])))
def _tours(suffixes: pa.Array) -> pa.Array:
    """The walk around each tree, from the suffix of every state in order."""
    out = []
    for sfx in suffixes.to_pylist():
        n = len(sfx)
        size, enter, free, chain = [1] * n, [0] * n, [1] * n, [0] * n
        for i in range(n - 1, 0, -1):  # a suffix lies before its state
            size[sfx[i]] += size[i]
        for i in range(1, n):
            up = sfx[i]
            enter[i], chain[i] = free[up], chain[up] + 1
            free[up] += 2 * size[i]
            free[i] = enter[i] + 1
        leave = [a + 2 * s - 1 for a, s in zip(enter, size)]
        out.append([dict(zip(_TOUR, row)) for row in zip(range(n), enter, leave, chain)])
    return pa.array(out, type=pa.list_(pa.struct([(c, pa.int32()) for c in _TOUR])))


def _bounded(index: Index) -> DataFrame:
    """``state, enter, leave, chain`` of sequences that a task may hold."""
    keys = list(index.keys)
    known = index.states.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    packed = known.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("state", "sfx"))).alias("s"))
    return packed.select(*keys, F.inline(_tours("s.sfx")))


def suffix_intervals(index: Index, limit: int = LIMIT) -> DataFrame:
    """``state, enter, leave`` for every state, state 0 included; siblings in ascending order."""
    keys = list(index.keys)
    if index.longest <= limit:
        return _bounded(index).select(*keys, "state", "enter", "leave")
    child = index.frames.select(*keys, F.col("sfx").alias("p"), "state", F.lit(1).alias("one"))
    child = running(child, [*keys, "p"], "state", index.longest, sums={"rank": F.col("one")})
    child = cut(child.select(*keys, "p", "state", "rank"))
    enter, leave = F.col("state") * 2, F.col("state") * 2 + 1

    first = child.where("rank = 1").select(*keys, F.col("p").alias("state"), F.col("state").alias("child"))
    down = index.states.select(*keys, "state").join(first, [*keys, "state"], "left")
    down = down.select(*keys, enter.alias("e"), F.coalesce(F.col("child") * 2, leave).alias("to"))
    after = child.select(*keys, "p", (F.col("rank") - 1).alias("rank"), F.col("state").alias("next"))
    on = child.join(after, [*keys, "p", "rank"], "left")
    on = on.select(*keys, leave.alias("e"), F.coalesce(F.col("next") * 2, F.col("p") * 2 + 1).alias("to"))
    root = index.states.where("state = 0").select(*keys, F.lit(1).alias("e"), F.lit(None).cast("int").alias("to"))
    hops = F.when(F.col("to").isNotNull(), 1).otherwise(0).alias("hops")
    ranked = cut(down.unionByName(on).unionByName(root).select(*keys, "e", "to", hops))

    span = 1
    while span < 2 * (index.longest + 1):
        going, ended = ranked.where("to IS NOT NULL"), ranked.where("to IS NULL")  # each event is followed by one other
        far = ranked.select(*keys, F.col("e").alias("to"), F.col("to").alias("then"), F.col("hops").alias("more"))
        moved = going.join(far, [*keys, "to"]).select(*keys, "e", F.col("then").alias("to"), (F.col("hops") + F.col("more")).alias("hops"))
        ranked = cut(moved.unionByName(ended))
        span *= 2
    state = F.floor(F.col("e") / 2).cast("int").alias("state")
    ends = ranked.groupBy(*keys, state).agg(F.max("hops").alias("a"), F.min("hops").alias("b"))
    total = ends.where("state = 0").select(*keys, F.col("a").alias("total"))
    placed = ends.join(total, keys)
    return placed.select(*keys, "state", (F.col("total") - F.col("a")).alias("enter"), (F.col("total") - F.col("b")).alias("leave"))


def subtrees(index: Index, limit: int = LIMIT) -> DataFrame:
    """``state, below, chain``: how many states hang below each one, and how long its suffix chain is."""
    keys = list(index.keys)
    if index.longest <= limit:
        below = F.expr("cast((leave - enter) div 2 AS int)").alias("below")
        return _bounded(index).select(*keys, "state", below, "chain")
    spans = cut(suffix_intervals(index, limit))
    steps = F.array(F.struct(F.col("enter").alias("at"), F.lit(1).alias("n")), F.struct(F.col("leave").alias("at"), F.lit(-1).alias("n")))
    depth = running(spans.select(*keys, F.inline(steps)), keys, "at", 2 * (index.longest + 1), sums={"open": F.col("n")})
    depth = depth.where("n = 1").select(*keys, F.col("at").alias("enter"), F.col("open"))
    below = F.floor((F.col("leave") - F.col("enter")) / 2).cast("int").alias("below")
    return spans.join(depth, [*keys, "enter"]).select(*keys, "state", below, (F.col("open") - 1).alias("chain"))
