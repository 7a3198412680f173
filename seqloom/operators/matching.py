"""Query-by-content and tracking: greedy walks of observations through an automaton.

One row per (observation sequence, model) pair carries both as arrays; Spark spreads
the pairs.  A step only needs the nearest frame of each cluster, so it costs one pass
over the model's frames however many start points are followed.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distance import row_metric
from ..sources import sequences
from .automaton import LIMIT, Index, build_index
from .walks import walk_by_maps

POLICIES = ("forward", "forward_self", "suffix")

_STEP = [("start", T.IntegerType()), ("t", T.IntegerType()), ("state", T.IntegerType()), ("cost", T.DoubleType())]
STEPS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _STEP]))
_STEPS_ARROW = pa.struct([("start", pa.int32()), ("t", pa.int32()), ("state", pa.int32()), ("cost", pa.float64())])


def models(index: Index, seqs: DataFrame) -> DataFrame:
    """One row per model: frames and link arrays of a bounded sequence."""
    index.require_bounded("a packed model")
    st = index.states.groupBy(*index.keys).agg(
        F.sort_array(F.collect_list(F.struct("state", "label", "sfx", "trn"))).alias("m")
    )
    links = st.select(
        *index.keys, *[F.col(f"m.{c}").alias(f"m_{c}") for c in ("label", "sfx", "trn")]
    )
    return links.join(sequences.pack(seqs).withColumnRenamed("items", "m_items"), "seq_id")


def _walks(index, seqs, obs, pairs, starts=None, limit=LIMIT, factor=None, **how) -> DataFrame:
    """Steps ``start, t, state, cost`` of every pair; ``cost`` accumulates.

    Bounded pairs are walked inside a task, longer ones by composed maps.  ``factor``
    cuts the observations into chunks, each walked on its own; a task takes a run of chunks
    (a model meets ``PARTS`` of them) and keeps the steps of each one's best path.
    """
    _check(how["policy"])
    keys = ["obs_id"] if factor is None else ["obs_id", "chunk"]
    longest = max(index.longest, sequences.lengths(obs).agg(F.max("n")).first()[0] or 0)
    if pairs is None:
        pairs = obs.select("seq_id").distinct().withColumn("obs_id", F.col("seq_id"))
    if longest > limit:
        numbered = sequences.number(obs)
        t = F.col("pos") if factor is None else (F.col("pos") - 1) % factor + 1
        cols = [F.col("seq_id").alias("obs_id"), t.cast("int").alias("t"), F.col("item").alias("q")]
        if factor is not None:
            cols.append(((F.col("pos") - 1) / factor).cast("int").alias("chunk"))
        return walk_by_maps(index, seqs, numbered.select(*cols), pairs, keys, starts, **how)
    named, parts, run = obs, [], 1
    if factor is not None:
        parts, run = ["part"], -(-longest // (factor * PARTS)) or 1  # chunks of a part
        named = sequences.number(obs, longest).select(
            "seq_id", ((F.col("pos") - 1) / (factor * run)).cast("int").alias("part"), F.struct("pos").alias("ord"), "item"
        )
    packed = sequences.pack(named, *parts).select(F.col("seq_id").alias("obs_id"), *parts, F.col("items").alias("o_items"))
    joined = pairs.join(packed, "obs_id").join(models(index, seqs), "seq_id")
    if starts is None:
        joined = joined.withColumn("starts", F.lit(None).cast("array<int>"))
    else:
        joined = joined.join(starts, "seq_id")
    joined = sequences.spread(joined, "seq_id", "obs_id", *parts)
    udf = F.arrow_udf(partial_walk(**how, factor=factor), STEPS)
    cols = ("m_items", "m_label", "m_sfx", "m_trn", "o_items", "starts")
    steps = joined.select("obs_id", *parts, "seq_id", F.inline(udf(*cols)))
    if factor is None:
        return steps
    chunk = F.col("part") * run + F.floor((F.col("t") - 1) / factor).cast("int")
    t = (F.pmod(F.col("t") - 1, F.lit(factor)) + 1).cast("int")
    return steps.select("obs_id", chunk.alias("chunk"), "seq_id", "start", t.alias("t"), "state", "cost")


PARTS = 8  # runs of chunks that meet a model apart: its copies, and the tasks of a pair


def partial_walk(**how):
    def walk(
        items: pa.Array, label: pa.Array, sfx: pa.Array, trn: pa.Array, obs: pa.Array, starts: pa.Array
    ) -> pa.Array:
        offsets, parts = [0], []
        for row in zip(items, label, sfx, trn, obs, starts):
            steps = _walk(*[v.as_py() for v in row], **how)
            offsets.append(offsets[-1] + len(steps[0]))
            parts.append(steps)
        cols = [np.concatenate([p[c] for p in parts]) if parts else np.array([]) for c in range(4)]
        arrays = [pa.array(c, type=f.type) for c, f in zip(cols, _STEPS_ARROW)]
        rows = pa.StructArray.from_arrays(arrays, fields=list(_STEPS_ARROW))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return walk


def _walk(items, label, sfx, trn, obs, starts, policy, nearest, expand=True, decay=1.0, weight=None, metric="sqeuclidean", factor=None):
    """Follow every start point through the observations, one nearest candidate per step.

    ``nearest`` starts at the closest frame of the start's cluster.  ``expand`` lets a
    link stand for its whole cluster.  ``weight`` blends in the distance from the frame
    after the previous state.  With ``factor`` the walk starts anew after so many observations
    and returns the steps of the cheapest path of each chunk, the first of equals.
    """
    x, q = np.array(items, dtype=float), np.array(obs, dtype=float)
    labels = np.array(label[1:])
    reach = partial(_reach, sfx, trn, _first_children(sfx))

    @lru_cache(len(x) + 1)
    def slots(p):
        return np.array([labels[j - 1] if expand else j - 1 for j in reach(p, policy)], dtype=int)

    order = np.argsort(labels, kind="stable")  # frames grouped by cluster, ascending inside
    heads = np.searchsorted(labels[order], np.arange(labels.max() + 1))
    everyone = np.arange(len(x))
    if weight is not None:
        lie = order if expand else everyone  # frames in the order of their groups
        place = np.empty_like(lie)
        place[lie] = everyone
        metre, ends = row_metric(metric, x[lie]), np.append(heads[1:], len(x))
        odd = not (np.isfinite(x).all() and np.isfinite(q).all())  # what is no number has no least: all frames are looked at
        kept, room = {}, KEPT

        def measured(p, at):
            """Weighted distances of the frames of some spans from the one after state ``p``."""
            if callable(metric):  # asked once a state
                rows = [np.concatenate([everyone[a:b] for a, b in at])]
            else:
                rows = [slice(c, min(c + ROWS, b)) for a, b in at for c in range(a, b, ROWS)]
            return weight * np.concatenate([metre(place[p], r) for r in rows])

        def apart(p, at):
            """The same, kept while there is room."""
            nonlocal room
            if p in kept:
                return kept[p]
            far = measured(p, at)
            if len(far) <= room:
                room -= len(far)
                kept[p] = far
            return far

        @lru_cache(len(x) + 1)
        def spans(p):
            """Where the groups that state ``p`` reaches lie, where each starts among them, and which one a slot is."""
            found, which = np.unique(slots(p), return_inverse=True)
            at = [(int(heads[g]), int(ends[g])) if expand else (int(g), int(g) + 1) for g in found]
            return at, np.cumsum([0] + [b - a for a, b in at[:-1]]), which

        def blended(p, own):
            """The state to move to from ``p``, and its cost; ``own`` are the weighted distances from the observation."""
            at, first, which = spans(p)
            d = np.concatenate([own[a:b] for a, b in at]) + apart(p, at)
            low = np.minimum.reduceat(d, first)
            best = which[int(np.argmin(low[which]))]
            a, b = at[best]
            nearest_one = int(np.argmin(d[first[best] : first[best] + b - a]))
            return int(lie[a + nearest_one]) + 1, low[best]

    def groups(d):
        """Smallest distance and its first state, per cluster (or per state)."""
        if not expand:
            return d, everyone + 1
        low = np.minimum.reduceat(d[order], heads)
        at = np.flatnonzero(d[order] == low[labels[order]])
        first = at[np.searchsorted(labels[order][at], np.arange(len(heads)))]
        return low, order[first] + 1

    if starts is None:
        starts = [int(s) for s in np.sort(order[heads]) + 1]
    out, walked = [], []
    for t, frame in enumerate(q):
        first = t % (factor or len(q)) == 0
        if first:
            here, cost = [], np.zeros(len(starts))
        d = _squares(x, frame)
        low, who = groups(d)
        if weight is not None:
            own = d * (1.0 - weight)
            ordered = own[lie]
        step = np.zeros(len(starts))
        moved: dict = {}  # many starts soon share a state
        for k, s in enumerate(starts):
            if first:
                state, step[k] = (who[labels[s - 1]], low[labels[s - 1]]) if nearest else (s, d[s - 1])
                here.append(int(state))
                continue
            p = here[k]
            if p not in moved and weight is not None and p < len(x) and not odd:
                moved[p] = blended(p, ordered)
            elif p not in moved:
                lo, wh = low, who
                if weight is not None and p < len(x):
                    lo, wh = groups(own + measured(p, [(0, len(x))])[place])
                best = slots(p)[int(np.argmin(lo[slots(p)]))]
                moved[p] = int(wh[best]), lo[best]
            here[k], step[k] = moved[p]
        cost = (cost if first else decay * cost) + step
        walked.append((np.arange(len(starts)), np.full(len(starts), t + 1), np.array(here), cost))
        if factor is not None and (t + 1 == len(q) or (t + 1) % factor == 0):
            k = np.lexsort((cost, np.isnan(cost)))[:1]
            out += [[c[k] for c in one] for one in walked]
            walked = []
    out += walked
    return [np.concatenate([o[c] for o in out]) for c in range(4)]


ROWS = 512  # frames measured at once, few enough to stay near the processor
KEPT = 1 << 24  # distances that a blended walk keeps for states it comes back to


def _squares(x: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """Squared distances of all frames from one."""
    out = np.empty(len(x))
    for at in range(0, len(x), ROWS):
        off = x[at : at + ROWS] - frame
        np.square(off, out=off).sum(axis=1, out=out[at : at + ROWS])
    return out


def _first_children(sfx) -> dict[int, int]:
    first: dict[int, int] = {}
    for i, s in enumerate(sfx[1:], 1):
        first.setdefault(s, i)
    return first


def _reach(sfx, trn, child, p, policy) -> list[int]:
    """States one step away from ``p``, in tie order."""
    forward = trn[p]
    if policy == "forward_self":
        return [*(forward or trn[sfx[p]]), p]
    if not forward or policy == "forward":
        return forward or trn[sfx[p]]
    back = trn[child[p]] if p in child else []
    return [*forward, *back, *trn[sfx[p]]]


def _check(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known: {POLICIES}")


def query_paths(
    index: Index, seqs: DataFrame, obs: DataFrame, pairs: DataFrame | None = None,
    policy: str = "forward_self", smooth: bool = False, weight: float = 0.5, metric: str = "sqeuclidean",
) -> DataFrame:
    """One greedy path per cluster: rows ``obs_id, seq_id, start, t, state, cost``.

    ``pairs`` (``obs_id, seq_id``) says which observations meet which model, by default
    the model of the same id.
    """
    how = {"policy": policy, "nearest": True, "weight": weight if smooth else None, "metric": metric}
    return _walks(index, seqs, obs, pairs, **how)


def best_path(paths: DataFrame, *keys: str) -> DataFrame:
    """The path with the least total cost; the first start wins ties."""
    keys = keys or ("obs_id", "seq_id")
    ends = paths.groupBy(*keys, "start").agg(F.max_by("cost", "t").alias("total"))
    best = ends.groupBy(*keys).agg(F.min(F.struct("total", "start")).alias("b"))
    return paths.join(best.select(*keys, F.col("b.start").alias("start"), "b.total"), [*keys, "start"])


def query_with_continuity(
    index: Index, seqs: DataFrame, obs: DataFrame, pairs: DataFrame | None = None,
    policy: str = "forward_self", smooth: bool = False, weight: float = 0.5, factor: int = 3,
) -> DataFrame:
    """Match chunks of ``factor`` observations and choose nearby states inside each chunk."""
    if factor not in (1, 2, 3):
        raise ValueError("the continuity factor is 1, 2 or 3")
    how = {"policy": policy, "nearest": True, "weight": weight if smooth else None}
    paths = _walks(index, seqs, obs, pairs, factor=factor, **how)
    best = best_path(paths, "obs_id", "seq_id", "chunk")
    options = best.join(index.states.select("seq_id", "state", "trn"), ["seq_id", "state"]).select(
        "obs_id", "seq_id", "chunk", "t", F.concat(F.array("state"), "trn").alias("options")
    )
    grouped = options.groupBy("obs_id", "seq_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("t", "options"))).alias("o")
    )
    return grouped.select(
        "obs_id", "seq_id", F.posexplode(_closest(F.col("o.options"))).alias("i", "state"), "chunk"
    ).select("obs_id", "seq_id", (F.col("chunk") * factor + F.col("i") + 1).alias("t"), "state")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _closest(options: pa.Array) -> pa.Array:
    return pa.array([closest_states(o) for o in options.to_pylist()], type=pa.list_(pa.int32()))


def closest_states(lists: list[list[int]]) -> list[int]:
    """One state per ascending list, close together along the lists' order.

    A merge moves the pointer at the smallest state and keeps the tightest choice seen,
    so it may miss a tighter one off its way.
    """
    if len(lists) == 1:
        return [min(lists[0])]
    at, best, pick = [0] * len(lists), float("inf"), []
    while all(i < len(one) for i, one in zip(at, lists)):
        now = [one[i] for i, one in zip(at, lists)]
        spread = sum(abs(a - b) for a, b in zip(now, now[1:]))
        if spread < best:
            best, pick = spread, now
        low = min(now)
        move = max(i for i, v in enumerate(now) if v == low)  # later lists move first on ties
        at[move] += 1
    return pick


def track(
    index: Index, seqs: DataFrame, obs: DataFrame, pairs: DataFrame | None = None,
    policy: str = "forward_self", nearest: bool = False, decay: float = 1.0, reverse_init: bool = False,
) -> DataFrame:
    """The state of the cheapest path at every step: ``obs_id, seq_id, t, state, cost``."""
    starts = reverse_starts(index, seqs) if reverse_init else None
    how = {"policy": policy, "nearest": nearest, "decay": decay}
    paths = _walks(index, seqs, obs, pairs, starts, **how)
    return _cheapest(paths, "start")


def _cheapest(paths: DataFrame, tie: str) -> DataFrame:
    now = paths.groupBy("obs_id", "seq_id", "t").agg(F.min(F.struct("cost", tie, "state")).alias("b"))
    return now.select("obs_id", "seq_id", "t", "b.state", "b.cost")


def reverse_starts(index: Index, seqs: DataFrame) -> DataFrame:
    """Start states from the clusters of the reversed sequence, moved to their cluster heads."""
    back = reverse_index(index, seqs)
    st = index.frames.select(*index.keys, "state", "label", "sfx")
    size = st.groupBy(*index.keys).agg(F.max("state").alias("n"))
    opened = back.frames.where("sfx = 0").select(*index.keys, F.col("state").alias("r"))
    mirrored = opened.join(size, list(index.keys)).select(
        *index.keys, "r", (F.col("n") + 1 - F.col("r")).alias("state")
    )
    heads = st.where("sfx = 0").select(*index.keys, "label", F.col("state").alias("head"))
    placed = mirrored.join(st, [*index.keys, "state"]).join(heads, [*index.keys, "label"])
    return placed.groupBy(*index.keys).agg(
        F.sort_array(F.collect_list(F.struct("r", "head"))).alias("s")
    ).select(*index.keys, F.col("s.head").alias("starts"))


def reverse_index(index: Index, seqs: DataFrame) -> Index:
    """The automaton of the reversed sequences, with the parameters of ``index``."""
    kind, threshold, metric, method = index.params
    return build_index(sequences.reverse(seqs, index.longest), kind, threshold, metric, method, longest=index.longest)


def align(
    index: Index, seqs: DataFrame, obs: DataFrame, pairs: DataFrame | None = None,
    policy: str = "forward_self", nearest: bool = False,
) -> DataFrame:
    """The single path from state 1: ``obs_id, seq_id, t, state, cost``."""
    starts = index.states.where("state = 1").select("seq_id", F.array("state").alias("starts"))
    paths = _walks(index, seqs, obs, pairs, starts, policy=policy, nearest=nearest)
    return paths.drop("start")


def track_gestures(
    index: Index, seqs: DataFrame, obs: DataFrame, pairs: DataFrame, self_transition: bool = True
) -> DataFrame:
    """Follow observations through several models at once: ``obs_id, t, gesture, state, cost``.

    ``pairs`` lists the candidate models of every observation sequence.  Each model is
    walked from its first state without cluster expansion; the cheapest so far wins.
    """
    starts = index.states.where("state = 1").select("seq_id", F.array("state").alias("starts"))
    policy = "forward_self" if self_transition else "forward"
    paths = _walks(index, seqs, obs, pairs, starts, policy=policy, nearest=False, expand=False)
    now = paths.groupBy("obs_id", "t").agg(F.min(F.struct("cost", "seq_id", "state")).alias("b"))
    return now.select("obs_id", "t", F.col("b.seq_id").alias("gesture"), "b.state", "b.cost")


def pattern_automata(index: Index, seqs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Automata of repeated patterns: ``seq_id, pattern, state, trn``.

    Every occurrence is indexed on its own with the parameters of ``index``; the links of
    all occurrences are united state by state onto the automaton of the first one.
    """
    kind, threshold, metric, method = index.params
    spans = patterns.select(
        "seq_id", "pattern", "len", F.posexplode("ends").alias("occ", "end")
    ).select("seq_id", "pattern", "occ", "len", F.explode(F.expr("sequence(end - len + 1, end)")).alias("pos"))
    items = sequences.number(seqs, index.longest)
    occurrence = F.struct("seq_id", "pattern", "occ")
    pieces = spans.join(items, ["seq_id", "pos"]).select(
        occurrence.alias("seq_id"), F.struct("pos").alias("ord"), "item"
    )
    built = build_index(pieces, kind, threshold, metric, method, longest=index.longest)
    links = built.links().select("seq_id.seq_id", "seq_id.pattern", F.col("src").alias("state"), "dst")
    return links.groupBy("seq_id", "pattern", "state").agg(F.sort_array(F.collect_set("dst")).alias("trn"))
