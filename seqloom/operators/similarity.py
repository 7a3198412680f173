"""Clusters, self-similarity and transitions read off the automaton table.

Matrices are sparse rows; positions are state numbers (1-based).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import running
from ..session import cut
from .automaton import Index
from .parse import encode, segment


def alphabet(index: Index) -> DataFrame:
    """Clusters numbered by first appearance, with the state that opened each."""
    return index.frames.where("sfx = 0").select(*index.keys, "label", F.col("state").alias("head"))


def clusters(index: Index) -> DataFrame:
    """Membership rows ``label, state`` - one row per state, never one list per cluster."""
    return index.frames.select(*index.keys, "label", "state")


def cluster_sizes(index: Index) -> DataFrame:
    return index.frames.groupBy(*index.keys, "label").agg(
        F.count(F.lit(1)).alias("size"), F.min("state").alias("head"), F.max("state").alias("tail")
    )


def running_lengths(index: Index) -> DataFrame:
    """Largest and mean repeat length up to every state."""
    lrs = F.col("lrs")
    df = index.running(index.frames.drop("trn"), sums={"total": lrs}, maxes={"max_lrs": lrs})
    return df.select(
        *index.keys, "state", "lrs", "max_lrs", (F.col("total") / F.col("state")).alias("avg_lrs")
    )


def self_similarity(index: Index, method: str = "rsfx", compat: bool = False) -> DataFrame:
    """The non-zero cells ``i, j`` of the self-similarity matrix.

    ``rsfx`` (same cluster) is a block matrix with as many cells as the squared cluster
    sizes; it comes factored, as ``i, label, row_sum``: cell (i, j) is 1 exactly when
    the labels agree.  ``compat`` places the words of ``com`` by copied length only, so
    new symbols do not advance.
    """
    if method == "rsfx":
        sizes = cluster_sizes(index).select(*index.keys, "label", F.col("size").alias("row_sum"))
        rows = clusters(index).withColumnRenamed("state", "i")
        return rows.join(sizes, [*index.keys, "label"]).select(*index.keys, "i", "label", "row_sum")
    if method == "sfx":
        return _both_ways(index, index.frames.where("sfx > 0"), F.col("state"), F.col("sfx"), F.lit(1))
    if method == "lrs":
        runs = repeat_runs(index)
        n = F.col("end") - F.col("start") + 1
        return _both_ways(index, runs, F.col("start"), F.col("start") - F.col("d"), n)
    if method in ("com", "comp"):
        words = encode(index).withColumn("at", F.col("word"))
        if compat:
            before = index.running(words, "end", sums={"done": F.col("len")})
            words = before.withColumn("at", F.col("done") - F.col("len"))
    elif method == "seg":
        words = segment(index)
    else:
        raise ValueError(f"unknown method {method!r}")
    n = F.greatest(F.col("len"), F.lit(1))
    cells = _both_ways(index, words, F.col("at") + 1, F.col("pos"), n).distinct()
    if method == "seg":
        inside = index.states.groupBy(*index.keys).agg(F.max("state").alias("n"))
        cells = cells.join(inside, list(index.keys)).where("i <= n AND j <= n").drop("n")
    return cells


def repeat_runs(index: Index) -> DataFrame:
    """The cells of the ``lrs`` matrix as runs ``d, start, end`` of its diagonals.

    States ``start`` to ``end`` repeat those ``d`` before.  There are never more runs than states,
    however many cells they have; :func:`repeat_tile` reads a part of them.  States in a row on one
    diagonal are merged first, then what overlaps or touches by counting open repeats.
    """
    keys, longest = list(index.keys), index.longest
    ends = index.frames.where("lrs > 0").select(
        *keys, "state", (F.col("state") - F.col("sfx")).alias("d"), (F.col("state") - F.col("lrs") + 1).alias("start")
    )
    before = ends.select(*keys, (F.col("state") + 1).alias("state"), F.col("d").alias("d_before"))
    opens = F.when(F.col("d_before").isNull() | (F.col("d_before") != F.col("d")), F.col("state"))
    owned = running(ends.join(before, [*keys, "state"], "left"), keys, "state", longest, maxes={"h": opens})
    rows = owned.groupBy(*keys, "h").agg(F.max("d").alias("d"), F.min("start").alias("start"), F.max("state").alias("end"))

    steps = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("n")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("n")))
    changes = rows.select(*keys, "d", F.inline(steps)).groupBy(*keys, "d", "at").agg(F.sum("n").alias("n"))
    open_ = running(changes, [*keys, "d"], "at", longest, sums={"open": F.col("n")})
    edges = open_.where("(open = 0) <> (open = n)")  # opened from none, or closed to none
    starts = F.when(F.col("open") > 0, 1).otherwise(0)
    numbered = running(edges, [*keys, "d"], "at", longest, sums={"run": starts})
    return numbered.groupBy(*keys, "d", "run").agg(F.min("at").alias("start"), (F.max("at") - 1).alias("end")).drop("run")


def repeat_tile(index: Index, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells of the ``lrs`` matrix inside a tile, read from the runs."""

    def inside(a, b):
        """Cells (i, i - d) with i in ``a`` and i - d in ``b``, as runs cut to the tile."""
        start = F.greatest("start", F.lit(a[0]), F.lit(b[0]) + F.col("d"))
        end = F.least("end", F.lit(a[1]), F.lit(b[1]) + F.col("d"))
        cut_runs = runs.withColumns({"start": start, "end": end}).where("start <= end")
        return cut_runs.select(*index.keys, "d", F.explode(F.sequence("start", "end")).alias("u"))

    runs = repeat_runs(index)
    below = inside(rows, cols).select(*index.keys, F.col("u").alias("i"), (F.col("u") - F.col("d")).alias("j"))
    above = inside(cols, rows).select(*index.keys, (F.col("u") - F.col("d")).alias("i"), F.col("u").alias("j"))
    return below.unionByName(above)


def _both_ways(index: Index, df: DataFrame, i: Column, j: Column, n: Column) -> DataFrame:
    """Cells of diagonal runs of length ``n`` from (i, j), mirrored."""
    runs = df.select(*index.keys, i.alias("a"), j.alias("b"), F.explode(F.sequence(F.lit(0), n - 1)).alias("d"))
    a, b = F.col("a") + F.col("d"), F.col("b") + F.col("d")
    pair = F.array(F.struct(a.alias("i"), b.alias("j")), F.struct(b.alias("i"), a.alias("j")))
    return runs.select(*index.keys, F.inline(pair))


def similarity_tile(index: Index, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells of the ``rsfx`` matrix inside a tile; the tile bounds the output per automaton."""
    keys = [*index.keys, "label"]
    a = clusters(index).where(F.col("state").between(*rows)).withColumnRenamed("state", "i")
    b = clusters(index).where(F.col("state").between(*cols)).withColumnRenamed("state", "j")
    return a.join(b, keys).select(*index.keys, "i", "j")


def transition(index: Index, method: str = "trn") -> DataFrame:
    """Transition probabilities between clusters: ``from, to, n, hist, prob``.

    ``seq`` counts neighbouring states, ``trn`` all forward links of the states that
    stand for items.  Clusters without links have no row.
    """
    if method == "seq":
        pairs = index.frames.where("state > 1").select(
            *index.keys, F.col("prev_label").alias("from"), F.col("label").alias("to")
        )
    elif method == "trn":
        links = index.frames.select(
            *index.keys, F.col("label").alias("from"), F.explode("trn").alias("state")
        )
        targets = index.frames.select(*index.keys, "state", F.col("label").alias("to"))
        pairs = links.join(targets, [*index.keys, "state"])
    else:
        raise ValueError(f"unknown method {method!r}")
    return with_row_share(pairs.groupBy(*index.keys, "from", "to").agg(F.count(F.lit(1)).alias("n")), index.keys)


def with_row_share(cells: DataFrame, keys) -> DataFrame:
    """Row totals ``hist`` and shares ``prob`` beside the cell counts ``n``."""
    hist = cells.groupBy(*keys, "from").agg(F.sum("n").alias("hist"))
    return cells.join(hist, [*keys, "from"]).withColumn("prob", F.col("n") / F.col("hist"))


def one_hot(index: Index) -> DataFrame:
    """Cluster indicator rows; ``n_labels`` is the width of the one-hot vector."""
    width = index.frames.where("sfx = 0").groupBy(*index.keys).agg(F.count(F.lit(1)).alias("n_labels"))
    return clusters(index).join(width, list(index.keys)).select(*index.keys, "state", "label", "n_labels")


def ancestors(index: Index) -> DataFrame:
    """All pairs ``state, ancestor, hops`` on suffix chains, state 0 left out.

    Read from ``state`` it is the suffix chain, read from ``ancestor`` the tree of
    reverse suffix links.  Pointer doubling: round r joins chains of length 2**r, so the
    number of joins is the logarithm of the longest chain.
    """
    keys = list(index.keys)
    jump = index.frames.where("sfx > 0").select(
        *keys, "state", F.col("sfx").alias("ancestor"), F.lit(1).alias("hops")
    )
    found, reach = jump, 1  # ``jump`` holds the pairs exactly ``reach`` hops apart
    while True:
        up = found.select(
            *keys, F.col("state").alias("mid"), F.col("ancestor").alias("top"), F.col("hops").alias("more")
        )
        linked = jump.withColumnRenamed("ancestor", "mid").join(up, [*keys, "mid"])
        further = cut(linked.select(*keys, "state", F.col("top").alias("ancestor"), F.expr("hops + more AS hops")))
        if further.isEmpty():
            return found
        found, reach = found.unionByName(further), 2 * reach
        jump = further.where(F.col("hops") == reach)
