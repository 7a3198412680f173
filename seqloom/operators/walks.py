"""Walks through models too long for one task, in jobs that grow with the log of the walk.

A greedy step leads to the nearest frame of some cluster, so after an observation a path
stands on one of as many states as there are clusters.  What the next observation does to
each of them is a map from cluster to cluster with a cost, and all observations' maps come from
one set of joins.  Maps over 1, 2, 4, ... observations are composed by joining a table of
maps with itself, and every round doubles the part of the paths that is known.

Where the distance from the natural successor is blended in, the state chosen inside a cluster
depends on the state before it, so there is no such map: those walks take a round of
joins per observation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import distance, sqeuclidean
from ..session import cut
from ..sources import sequences
from .automaton import Index


def reachable(index: Index, policy: str) -> DataFrame:
    """States one step away: ``seq_id, p, slot, to``; ``slot`` is the tie order."""
    st = index.states.select("seq_id", "state", "sfx", "trn")

    def targets(df, part):
        slot = F.struct(F.lit(part).alias("part"), F.col("to")).alias("slot")
        return df.select("seq_id", "p", F.explode("via").alias("to")).select("seq_id", "p", slot, "to")

    def through(df, at):
        via = st.select("seq_id", F.col("state").alias(at), F.col("trn").alias("via"))
        return df.withColumnRenamed("state", "p").join(via, ["seq_id", at])

    some, none = (st.where(c) for c in ("state > 0 AND size(trn) > 0", "state > 0 AND size(trn) = 0"))
    own = some.select("seq_id", F.col("state").alias("p"), F.col("trn").alias("via"))
    parts = [targets(own, 0), targets(through(none, "sfx"), 0)]
    if policy == "forward_self":
        stay = index.frames.select("seq_id", F.col("state").alias("p"), F.array("state").alias("via"))
        parts.append(targets(stay, 1))
    if policy == "suffix":
        child = index.frames.groupBy("seq_id", F.col("sfx").alias("state")).agg(F.min("state").alias("child"))
        parts.append(targets(through(some.join(child, ["seq_id", "state"]), "child"), 1))
        parts.append(targets(through(some, "sfx"), 2))
    return reduce(DataFrame.unionByName, parts)


def walk_by_maps(
    index: Index, seqs, obs, pairs, keys, starts, policy, nearest,
    expand=True, decay=1.0, weight=None, metric="sqeuclidean",
) -> DataFrame:
    """Steps ``start, t, state, cost`` as the in-task walks return them.

    ``obs`` has ``keys, t, q``; ``starts`` ``seq_id, starts`` or nothing for all clusters.
    """
    on = [*keys, "seq_id"]
    items = sequences.number(seqs).select("seq_id", F.col("pos").alias("state"), F.col("item").alias("x"))
    frames = cut(index.frames.select("seq_id", "state", "label").join(items, ["seq_id", "state"]))
    group = F.col("label") if expand else F.col("state")
    near = pairs.join(obs, ["obs_id"]).join(frames.withColumn("g", group), "seq_id")
    apart = near.withColumn("d", sqeuclidean("q", "x"))
    low = cut(apart.groupBy(*on, "t", "g").agg(F.min(F.struct("d", "state")).alias("m")))
    low = low.select(*on, "t", "g", "m.d", F.col("m.state").alias("who"))

    labels = frames.select("seq_id", F.col("state").alias("to"), F.col("label"))
    reach = reachable(index, policy).join(labels, ["seq_id", "to"])
    reach = cut(reach.withColumn("next", F.col("label") if expand else F.col("to")).drop("label"))

    def steps(places, *carried):
        """The best next ``g``, its cost ``d`` and state ``who`` from states ``p`` at ``t``."""
        moves = places.join(reach, ["seq_id", "p"])
        if weight is None:
            options = moves.join(_sooner(low).withColumnRenamed("g", "next"), [*on, "t", "next"])
        else:
            options = _blended(moves, frames, _sooner(obs), [*keys, "t"], weight, metric, expand)
        best = options.groupBy(*on, "t", *carried).agg(F.min(F.struct("d", "slot", "who", "next")).alias("b"))
        return best.select(*on, "t", *carried, "b.d", "b.who", "b.next")

    first = cut(_first_step(index, frames, obs, pairs, low, starts, nearest, on))
    after = first.select(*on, "start", "t", F.col("state").alias("p"), "cost")
    total = F.col("cost") * decay + F.col("d")
    later = F.col("t") + 1
    if weight is not None:
        walked = [first]
        for _ in range((obs.agg(F.max("t")).first()[0] or 1) - 1):
            moved = steps(after, "start", "cost").select(*on, "start", later.alias("t"), F.col("who").alias("p"), total.alias("cost"))
            after = cut(moved)
            walked.append(after.select(*on, "start", "t", F.col("p").alias("state"), "cost"))
        return reduce(DataFrame.unionByName, walked)
    second = steps(after, "start", "cost").select(*on, "start", later.alias("t"), F.col("next").alias("g"), total.alias("cost"))
    second = cut(second)
    moved = steps(low.where("t > 1").select(*on, "t", "g", F.col("who").alias("p")), "g")
    maps = cut(moved.select(*on, "t", "g", "next", F.col("d").alias("more")))
    paths = _followed(second, maps, on, decay)
    state = low.select(*on, "t", "g", F.col("who").alias("state"))
    return first.unionByName(paths.join(state, [*on, "t", "g"]).select(*first.columns))


def _sooner(table: DataFrame) -> DataFrame:
    """What belongs to the observation after ``t``."""
    return table.withColumn("t", (F.col("t") - 1).cast("int"))


def _followed(paths: DataFrame, maps: DataFrame, on, decay: float) -> DataFrame:
    """Paths from their second observation to their last, by maps of doubling span."""
    span, last = 1, maps.agg(F.max("t")).first()[0] or 0
    while span < last:
        fade = decay**span
        cost = (F.col("cost") * fade + F.col("more")).alias("cost")
        landed = paths.join(maps, [*on, "t", "g"])
        landed = landed.select(*on, "start", (F.col("t") + span).cast("int").alias("t"), F.col("next").alias("g"), cost)
        paths = cut(paths.unionByName(landed))
        after = maps.select(*on, (F.col("t") - span).cast("int").alias("t"), F.col("g").alias("next"), F.col("next").alias("then"), F.col("more").alias("then_more"))
        both = maps.join(after, [*on, "t", "next"])
        maps = cut(both.select(*on, "t", "g", F.col("then").alias("next"), (F.col("more") * fade + F.col("then_more")).alias("more")))
        span *= 2
    return paths


def _first_step(index, frames, obs, pairs, low, starts, nearest, on) -> DataFrame:
    if starts is None:
        heads = index.frames.where("sfx = 0").select("seq_id", F.col("label").alias("start"), F.col("state").alias("p"))
    else:
        heads = starts.select("seq_id", F.posexplode("starts").alias("start", "p"))
    begun = pairs.join(heads, "seq_id").join(
        frames.select("seq_id", F.col("state").alias("p"), F.col("label").alias("g"), "x"), ["seq_id", "p"]
    )
    if nearest:
        placed = begun.join(low.where("t = 1"), [*on, "g"])
        return placed.select(*on, "start", "t", F.col("who").alias("state"), F.col("d").alias("cost"))
    placed = begun.join(obs.where("t = 1"), [c for c in on if c != "seq_id"])
    return placed.select(*on, "start", "t", F.col("p").alias("state"), sqeuclidean("q", "x").alias("cost"))


def _blended(moves, frames, obs, on, weight, metric, expand) -> DataFrame:
    """Candidates whose distance also counts how far they are from the natural successor."""
    after = frames.select("seq_id", (F.col("state") - 1).alias("p"), F.col("x").alias("next_x"))
    seen = moves.join(after, ["seq_id", "p"], "left").join(obs, list(on))
    group = F.col("label") if expand else F.col("state")
    members = frames.select("seq_id", F.col("state").alias("who"), group.alias("next"), "x")
    options = seen.join(members, ["seq_id", "next"])
    plain = sqeuclidean("q", "x")
    mixed = plain * (1.0 - weight) + distance("next_x", "x", metric) * weight
    d = F.when(F.col("next_x").isNull(), plain).otherwise(mixed)
    return options.withColumn("d", d)
