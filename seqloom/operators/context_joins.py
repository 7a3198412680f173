"""Acceptance and prediction for models too long for one task, by joins on their links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources import sequences
from .automaton import Index
from .similarity import ancestors

ASK = ["seq_id", "ctx_id"]


def named_links(index: Index, seqs: DataFrame) -> DataFrame:
    """Forward links with the symbol they read: ``seq_id, src, symbol, dst``."""
    items = sequences.number(seqs, index.longest).select("seq_id", F.col("pos").alias("dst"), F.col("item").alias("symbol"))
    return cut(index.links().join(items, ["seq_id", "dst"]))


def spelled(links: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every context without its first ``d`` symbols, followed from state 0.

    Rows ``d, ok, state``: whether it is spelled to its end and the last state reached.
    One round of joins per symbol moves all contexts at once.
    """
    drop = F.explode(F.sequence(F.lit(0), F.size("context"))).alias("d")
    here = contexts.select(*ASK, "context", drop).withColumn("state", F.lit(0)).withColumn("at", F.col("d"))
    steps = links.select("seq_id", F.col("src").alias("state"), F.col("symbol").alias("next"), "dst")
    done = []
    while not here.isEmpty():
        ended = F.col("at") == F.size("context")
        done.append(here.where(ended).withColumn("ok", F.lit(True)))
        going = here.where(~ended).withColumn("next", F.get("context", F.col("at")))
        moved = cut(going.join(steps, ["seq_id", "state", "next"], "left"))
        done.append(moved.where("dst IS NULL").withColumn("ok", F.lit(False)))
        here = moved.where("dst IS NOT NULL").select(
            *ASK, "context", "d", F.col("dst").alias("state"), (F.col("at") + 1).alias("at")
        )
    cols = [*ASK, F.size("context").alias("size"), "d", "state", "ok"]
    return cut(reduce(DataFrame.unionByName, [df.select(*cols) for df in done]))


def accept_by_joins(index: Index, seqs: DataFrame, contexts: DataFrame) -> DataFrame:
    whole = spelled(named_links(index, seqs), contexts).where("d = 0")
    return whole.select(*ASK, F.col("ok").alias("accepted"), "state")


def predict_by_joins(index: Index, seqs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows ``ctx_id, used, symbol, prob`` as the in-task prediction returns them."""
    links = named_links(index, seqs)
    tried = spelled(links, contexts)
    kept = tried.where("ok").groupBy(*ASK).agg(F.min("d").alias("first"))
    tried = tried.join(kept, ASK).where("d >= first").withColumn("used", F.col("size") - F.col("d"))

    child = index.frames.select("seq_id", "state", "sfx", "lrs")
    longest = child.groupBy("seq_id", F.col("sfx").alias("state")).agg(F.max("lrs").alias("top"))
    usable = tried.join(longest, ["seq_id", "state"]).where("top >= used")
    best = usable.groupBy(*ASK).agg(F.min(F.struct("d", "state", "used")).alias("b"))
    chosen = cut(best.select(*ASK, "b.state", "b.used"))

    # symbol counts below every state, then per parent and repeat length
    up = ancestors(index).select("seq_id", F.col("state").alias("src"), F.col("ancestor").alias("state"))
    itself = child.select("seq_id", F.col("state").alias("src"), "state")
    below = links.join(up.unionByName(itself), ["seq_id", "src"]).groupBy("seq_id", "state", "symbol").agg(
        F.count(F.lit(1)).alias("n")
    )
    by_parent = below.join(child, ["seq_id", "state"]).groupBy(
        "seq_id", F.col("sfx").alias("state"), "lrs", "symbol"
    ).agg(F.sum("n").alias("n"))
    own = links.select("seq_id", F.col("src").alias("state"), "symbol")

    similar = chosen.join(by_parent, ["seq_id", "state"]).where("lrs >= used").select(*ASK, "symbol", "n")
    direct = chosen.join(own, ["seq_id", "state"]).select(*ASK, "symbol", F.lit(1).alias("n"))
    known = links.where("src = 0").select("seq_id", "symbol")
    base = chosen.join(known, "seq_id").select(*ASK, "symbol", F.lit(1).alias("n"))
    counts = similar.unionByName(direct).unionByName(base).groupBy(*ASK, "symbol").agg(F.sum("n").alias("n"))
    total = counts.groupBy(*ASK).agg(F.sum("n").alias("total"))
    shares = counts.join(total, ASK).join(chosen.select(*ASK, "used"), ASK)
    return shares.select(*ASK, "used", "symbol", (F.col("n") / F.col("total")).alias("prob"))
