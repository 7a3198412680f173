"""Automata of sequences too long for one task, built by joins over all states at once.

The link of a state is a function of the links of earlier states.  Every round applies
that function to all states in parallel, reading the tables of the round before, until
nothing changes.  After a round the first wrong state moves forward by at least one, and
a table that a round leaves unchanged is the sequential result: by induction over the
states, each one then was computed from right inputs.  Independent parts settle together.

Symbol sequences start from their longest earlier repeats (:mod:`seqloom.operators.earlier`),
which is nearly the result.  So that a state still wrong does not spoil the right ones after it,
a round only moves states whose predecessor agrees with its own inputs (the first wrong state
is one of them), and what moves carries the states behind it along as long as their items
agree with the earlier copy.  A few rounds settle long repeats, repeats inside repeats and periods.
Suffix chains are climbed by pointer doubling: links over 1, 2, 4, ... states, so a long chain
costs joins with its logarithm.  Frames have no such start and are still matched link by
link, since a match at one state says nothing about the next.

Tables per automaton (``keys``): nodes ``i, sfx, lrs, head`` (``head`` is the state that
opened the cluster, state 0 included) and edges ``k, t``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import pair_distance
from ..functions.orbit import orbit
from ..functions.scan import running
from ..session import cut
from ..sources import sequences
from .earlier import longest_earlier


def link_by_rounds(seqs: DataFrame, keys, kind, threshold, metric, method) -> DataFrame:
    """State rows as ``build_index`` returns them, for sequences of any length."""
    items = _items(seqs, keys, kind, threshold)
    symbolic = kind == "symbolic"
    longest = items.agg(F.max("i")).first()[0]
    nodes, edges = _first_guess(items, keys, symbolic, longest)
    while True:
        ups = Ancestors(nodes, keys)
        found, new_edges = _walk(items, nodes, edges, ups, keys, symbolic, metric, method == "complete")
        new_nodes = cut(_lengths(found, nodes, ups, keys))
        settled = _same(nodes, new_nodes, keys)
        same = settled and _same(edges, new_edges, keys)
        if symbolic and not settled:
            new_nodes = cut(_moved(new_nodes, nodes, keys, longest))
        nodes, edges = new_nodes, new_edges
        if same:
            return _as_states(nodes, edges, keys)


class Ancestors:
    """Suffix links over 1, 2, 4, ... states: tables ``i, up``, made when they are asked for."""

    def __init__(self, nodes: DataFrame, keys):
        self.by = list(keys)
        self.tables = [cut(nodes.where("sfx >= 0").select(*self.by, "i", F.col("sfx").alias("up")))]

    def levels(self) -> int:
        """Number of levels that have links."""
        while not self.tables[-1].isEmpty():
            near, far = self.tables[-1], self.tables[-1].select(*self.by, F.col("i").alias("up"), F.col("up").alias("far"))
            self.tables.append(cut(near.join(far, [*self.by, "up"]).select(*self.by, "i", F.col("far").alias("up"))))
        return len(self.tables) - 1

    def at(self, level: int, place: str, name: str) -> DataFrame:
        """The links of a level for the states in the column ``place``."""
        return self.tables[level].select(*self.by, F.col("i").alias(place), F.col("up").alias(name))


def _items(seqs: DataFrame, keys, kind, threshold) -> DataFrame:
    """Items ``i, x, thr``; a symbol is named by the position of its first occurrence."""
    items = sequences.number(seqs).withColumnRenamed("pos", "i").withColumnRenamed("item", "x")
    if kind == "symbolic":
        first = items.groupBy("seq_id", "x").agg(F.min("i").alias("first"))
        first = first.select(F.col("seq_id").alias("of"), F.col("x").alias("symbol"), "first")
        same = (F.col("seq_id") == F.col("of")) & F.col("x").eqNullSafe(F.col("symbol"))  # a null is a symbol too
        named = items.join(first, same).select("seq_id", "i", F.col("first").alias("x"))
        return cut(named.withColumn("thr", F.lit(0.0)))
    if isinstance(threshold, DataFrame):
        return cut(items.join(threshold.select("seq_id", F.col("threshold").alias("thr")), "seq_id"))
    if "threshold" in keys:
        grid = F.explode(F.array(*[F.lit(float(t)) for t in threshold])).alias("threshold")
        items = items.select("*", grid).withColumn("thr", F.col("threshold"))
        return cut(items)
    return cut(items.withColumn("thr", F.lit(float(threshold))))


def _first_guess(items: DataFrame, keys, symbolic: bool, longest: int):
    """Links between neighbours, and the longest earlier repeats of symbols or no suffixes yet."""
    zero = items.where("i = 1").select(*keys, F.lit(0).alias("i"), F.lit(-1).alias("sfx"), F.lit(0).alias("lrs"), F.lit(0).alias("head"))
    edges = cut(items.select(*keys, (F.col("i") - 1).alias("k"), F.col("i").alias("t")))
    if not symbolic:
        rest = items.select(*keys, "i", F.lit(0).alias("sfx"), F.lit(0).alias("lrs"), F.col("i").alias("head"))
        return cut(zero.unionByName(rest)), edges
    repeats = longest_earlier(items, keys, longest)
    rest = items.select(*keys, "i", F.col("x").alias("head")).join(repeats, [*keys, "i"])
    rest = rest.select(*keys, "i", F.col("end").alias("sfx"), F.col("len").alias("lrs"), "head")
    nodes = cut(zero.unionByName(rest))
    _, edges = _walk(items, nodes, edges, Ancestors(nodes, keys), keys, True, None, False)
    return nodes, edges


def _at(nodes: DataFrame, keys, place: str, **names: str) -> DataFrame:
    """Node columns under new names, keyed by the column ``place``."""
    return nodes.select(*keys, F.col("i").alias(place), *[F.col(c).alias(n) for c, n in names.items()])


def _walk(items, nodes, edges, ups, keys, symbolic, metric, exhaustive):
    """Climb the suffix chain of every state's predecessor to the nearest matching link.

    Returns ``i, s, below`` (``s`` null for a new cluster) and the edges the walks add.
    """
    if symbolic:
        return _walk_symbols(items, nodes, edges, ups, list(keys))
    return _walk_frames(items, nodes, edges, list(keys), metric, exhaustive)


def _walk_symbols(items, nodes, edges, ups, by):
    """The walk by descending jumps: states below a match have no link with the symbol."""
    # the links of a state have distinct symbols: the earliest target of each counts
    named = items.select(*by, F.col("i").alias("t"), "x")
    targets = cut(edges.join(named, [*by, "t"]).groupBy(*by, "k", "x").agg(F.min("t").alias("t")))

    def hit(walkers, place):
        """The earlier target with the walker's symbol at the state in ``place``, or null."""
        # at state 0 the first occurrence itself is the target, so no join meets that key
        there = targets.where("k > 0").select(*by, F.when(F.col("k") > 0, F.col("k")).alias(place), "x", "t")
        met = walkers.join(there, [*by, place, "x"], "left")
        t = F.when(F.col(place) == 0, F.col("x")).otherwise(F.col("t"))
        return met.withColumn("t", F.when(t < F.col("i"), t))

    walkers = items.select(*by, "i", "x", (F.col("i") - 1).alias("below"))
    walkers = walkers.join(_at(nodes, by, "below", sfx="k"), [*by, "below"])
    first = cut(hit(walkers, "k"))
    done = first.where("t IS NOT NULL OR k < 0").select(*by, "i", "below", F.col("t").alias("s"))
    missed = cut(first.where("t IS NULL AND k >= 0").select(*by, "i", "x", "k", F.col("k").alias("at"), F.lit(1).alias("n")))
    if missed.isEmpty():
        return done, cut(edges.where("t = k + 1"))
    climbed, levels = missed, ups.levels()
    for r in range(levels - 1, -1, -1):
        tried = hit(climbed.join(ups.at(r, "at", "up"), [*by, "at"], "left"), "up")
        on = F.col("up").isNotNull() & F.col("t").isNull()
        climbed = cut(tried.select(
            *by, "i", "x", "k", F.when(on, F.col("up")).otherwise(F.col("at")).alias("at"),
            (F.col("n") + F.when(on, 2**r).otherwise(0)).alias("n"),
        ))
    ended = hit(climbed.join(ups.at(0, "at", "up"), [*by, "at"], "left"), "up")
    found = done.unionByName(ended.select(*by, "i", F.col("at").alias("below"), F.col("t").alias("s")))
    passed = climbed.select(*by, "i", "k", "n")
    most = passed.agg(F.max("n")).first()[0]
    for r in range((most - 1).bit_length() - 1, -1, -1):  # every climb in halves, down to single states
        far = F.struct(F.col("up").alias("k"), (F.col("n") - 2**r).alias("n"))
        near = F.struct("k", F.lit(2**r).alias("n"))
        parts = F.when(F.col("n") > 2**r, F.array(near, far)).otherwise(F.array(F.struct("k", "n")))
        passed = passed.join(ups.at(r, "k", "up"), [*by, "k"], "left").select(*by, "i", F.explode(parts).alias("p"))
        passed = cut(passed.select(*by, "i", "p.k", "p.n"))
    added = passed.select(*by, "k", F.col("i").alias("t"))
    return cut(found), cut(edges.where("t = k + 1").unionByName(added))


def _walk_frames(items, nodes, edges, by, metric, exhaustive):
    """The walk from link to link, all states of the sequence at once."""
    named = items.select(*by, F.col("i").alias("t"), F.col("x").alias("y"))
    targets = cut(edges.join(named, [*by, "t"]))
    walkers = cut(
        items.withColumn("below", F.col("i") - 1)
        .join(_at(nodes, by, "below", sfx="k"), [*by, "below"])
        .select(*by, "i", "x", "thr", "k", "below", F.lit(None).cast("struct<d:double,t:int>").alias("best"))
    )
    done, added = [], [edges.where("t = k + 1")]
    while True:
        done.append(walkers.where("k < 0").select(*by, "i", "below", F.col("best.t").alias("s")))
        open_ = walkers.where("k >= 0")
        probed = _probe(open_, targets, by, metric)
        up = _at(nodes, by, "k", sfx="up")
        probed = cut(probed.join(up, [*by, "k"], "left"))
        if probed.isEmpty():
            break
        missed = probed.where("hit IS NULL")
        added.append(missed.select(*by, "k", F.col("i").alias("t")))
        better = F.expr("IF(hit IS NOT NULL AND (best IS NULL OR hit.d < best.d), hit, best)")
        below = F.expr("IF(hit IS NULL, k, below)")
        if exhaustive:
            going = probed
        else:
            going = missed
            done.append(probed.where("hit IS NOT NULL").select(*by, "i", "below", F.col("hit.t").alias("s")))
        walkers = going.select(*by, "i", "x", "thr", F.col("up").alias("k"), below.alias("below"), better.alias("best"))
    found = cut(reduce(DataFrame.unionByName, done))
    return found, cut(reduce(DataFrame.unionByName, added))


def _probe(walkers, targets, by, metric) -> DataFrame:
    """The nearest earlier target of ``k`` that matches item ``i``: ``hit`` or null."""
    near = walkers.join(targets, [*by, "k"]).where("t < i").withColumn("d", pair_distance(metric)("x", "y"))
    # partial aggregation keeps one candidate per state and task, however many targets k has
    hits = near.where("d < thr").groupBy(*by, "i").agg(F.min(F.struct("d", "t")).alias("hit"))
    return walkers.join(hits, [*by, "i"], "left")


def _lengths(found, nodes, ups, keys) -> DataFrame:
    """Repeat lengths of the walked states, after the earlier-twin refinement."""
    by = list(keys)
    zero = nodes.where("i = 0")
    new = found.where("s IS NULL").select(*by, "i", F.lit(0).alias("sfx"), F.lit(0).alias("lrs"), F.col("i").alias("head"))
    below = _at(nodes, keys, "below", sfx="below_sfx", lrs="below_lrs")
    linked = found.where("s IS NOT NULL").join(below, [*by, "below"]).withColumn("b", F.col("s") - 1)
    linked = cut(linked)
    direct = F.col("b") == F.col("below_sfx")
    climbed = cut(linked.where(~direct & (F.col("b") > F.col("below_sfx"))).select(*by, "i", "b", F.col("below_sfx").alias("p")))
    if not climbed.isEmpty():
        for r in range(ups.levels() - 1, -1, -1):  # links lead to smaller states: the last one above the shared suffix
            up = F.when(F.col("up") > F.col("p"), F.col("up")).otherwise(F.col("b"))
            climbed = cut(climbed.join(ups.at(r, "b", "up"), [*by, "b"], "left").select(*by, "i", up.alias("b"), "p"))
    ends = climbed.join(_at(nodes, keys, "b", sfx="b_sfx", lrs="b_lrs"), [*by, "b"]).where("b_sfx = p")
    shared = linked.join(ends.select(*by, "i", "b_lrs"), [*by, "i"], "left")
    size = F.when(direct, F.col("below_lrs")).otherwise(F.least("below_lrs", F.coalesce("b_lrs", F.lit(0)))) + 1
    linked = shared.select(*by, "i", "s", size.alias("size"))
    linked = linked.withColumn("at", F.col("i") - F.col("size")).join(
        _at(nodes, keys, "at", head="before"), [*by, "at"], "left"
    )
    twins = (
        nodes.where("lrs > 0")
        .withColumn("at", F.col("i") - F.col("lrs"))
        .join(_at(nodes, keys, "at", head="before"), [*by, "at"])
        .groupBy(*by, F.col("sfx").alias("s"), F.col("lrs").alias("size"), "before")
        .agg(F.min("i").alias("twin"))
    )
    heads = _at(nodes, keys, "s", head="head")
    refined = linked.join(twins, [*by, "s", "size", "before"], "left").join(heads, [*by, "s"])
    earlier = F.col("twin") < F.col("i")
    refined = refined.select(
        *by, "i",
        F.when(earlier, F.col("twin")).otherwise(F.col("s")).alias("sfx"),
        F.when(earlier, F.col("size") + 1).otherwise(F.col("size")).alias("lrs"),
        "head",
    )
    return zero.unionByName(new).unionByName(refined)


def _moved(computed: DataFrame, nodes: DataFrame, keys, longest: int) -> DataFrame:
    """The nodes of the next round: states behind settled ones move and carry others along."""
    by = list(keys)
    old = nodes.select(*by, "i", F.col("sfx").alias("sfx_was"), F.col("lrs").alias("lrs_was"))
    off = (F.col("sfx") != F.col("sfx_was")) | (F.col("lrs") != F.col("lrs_was"))
    checked = cut(computed.join(old, [*by, "i"]).withColumn("off", off))
    shaky = checked.where("off").select(*by, (F.col("i") + 1).alias("i"), F.lit(True).alias("shaky"))
    checked = checked.join(shaky, [*by, "i"], "left").withColumn("moves", F.col("off") & F.col("shaky").isNull())
    led = running(checked, by, "i", longest, maxes={"lead": F.when(F.col("moves"), F.struct("i", "sfx", "lrs"))})
    copy = F.when(~F.col("moves") & (F.col("lead.sfx") > 0), F.col("i") - F.col("lead.i") + F.col("lead.sfx"))
    there = nodes.select(*by, F.col("i").alias("copy"), F.col("head").alias("item"))  # the head of a symbol names it
    met = led.withColumn("copy", copy).join(there, [*by, "copy"], "left")
    parted = F.when(F.coalesce(F.col("item") != F.col("head"), F.lit(True)), F.col("i"))
    led = running(met, by, "i", longest, maxes={"parted": F.when(~F.col("moves"), parted)})
    carried = F.col("copy").isNotNull() & (F.coalesce("parted", F.lit(-1)) < F.col("lead.i"))

    def value(name, behind):
        return F.when(F.col("moves"), F.col(name)).when(carried, behind).otherwise(F.col(f"{name}_was")).alias(name)

    on = F.col("i") - F.col("lead.i")
    return led.select(*by, "i", value("sfx", F.col("copy")), value("lrs", F.col("lead.lrs") + on), "head")


def _same(old: DataFrame, new: DataFrame, keys) -> bool:
    """Whether two tables without duplicate rows hold the same rows."""
    both = old.unionByName(new).groupBy(*old.columns).agg(F.count(F.lit(1)).alias("n"))
    return both.where("n <> 2").isEmpty()


def _as_states(nodes: DataFrame, edges: DataFrame, keys) -> DataFrame:
    by = list(keys)
    longest = nodes.agg(F.max("i")).first()[0]
    opened = running(
        nodes.where("i > 0"), by, "i", longest, sums={"seen": F.when(F.col("sfx") == 0, 1).otherwise(0)}
    )
    label = opened.where("sfx = 0").select(*by, F.col("i").alias("head"), (F.col("seen") - 1).cast("int").alias("label"))
    labelled = cut(nodes.join(label, [*by, "head"], "left"))
    before = labelled.select(*by, (F.col("i") + 1).alias("i"), F.col("label").alias("prev_label"))
    trn = edges.groupBy(*by, F.col("k").alias("i")).agg(F.sort_array(F.collect_list("t")).alias("trn"))
    words = _words(nodes, by, longest)
    rows = labelled.join(before, [*by, "i"], "left").join(trn, [*by, "i"], "left").join(words, [*by, "i"], "left")
    return rows.select(
        *by, F.col("i").alias("state"), F.when(F.col("i") > 0, F.col("sfx")).alias("sfx"), "lrs", "label",
        "prev_label", F.coalesce("word", F.lit(0)).alias("word"), F.coalesce("word_end", F.lit(0)).alias("word_end"),
        F.coalesce("trn", F.expr("cast(array() AS array<int>)")).alias("trn"),
    )


def _words(nodes: DataFrame, by, longest: int) -> DataFrame:
    """The word of every state: ``i, word, word_end``.

    A word from ``j`` runs while repeats reach back to ``j``, so its end is a function of
    ``j`` alone: the number of states whose largest repeat start so far is at most ``j``.
    The starts in use are those reached from 0, found by pointer doubling.
    """
    reach = running(nodes.where("i > 0"), by, "i", longest, maxes={"from": F.col("i") - F.col("lrs")})
    stops = reach.groupBy(*by, F.col("from").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    ends = running(
        nodes.select(*by, "i").join(stops, [*by, "i"], "left"), by, "i", longest,
        sums={"within": F.coalesce("n", F.lit(0))},
    )
    last = nodes.groupBy(*by).agg(F.max("i").alias("last"))
    nxt = ends.join(last, by).where("i < last").select(
        *by, F.col("i").alias("j"), F.greatest(F.col("i") + 1, F.col("within")).cast("int").alias("to")
    )
    nxt = cut(nxt)
    starts = nodes.where("i = 0").select(*by, F.col("i").alias("j"))
    starts = orbit(starts, nxt, by, longest)
    opened = starts.join(nxt, [*by, "j"]).select(*by, (F.col("j") + 1).alias("i"), "j", "to")
    marked = nodes.where("i > 0").select(*by, "i").join(opened, [*by, "i"], "left")
    named = running(marked, by, "i", longest, maxes={"word": F.col("j"), "word_end": F.col("to")})
    return named.select(*by, "i", "word", "word_end")
