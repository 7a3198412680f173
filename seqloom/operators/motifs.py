"""Repeated patterns, fragments and the pattern matrix."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.orbit import nearest_larger_before, orbit
from ..session import cut
from ..sources.sequences import together
from .automaton import LIMIT, Index
from .similarity import cluster_sizes

PATTERNS = T.ArrayType(
    T.StructType(
        [
            T.StructField("pattern", T.IntegerType()),
            T.StructField("ends", T.ArrayType(T.IntegerType())),
            T.StructField("len", T.IntegerType()),
        ]
    )
)


def find_repeated_patterns(index: Index, lower: int = 1) -> DataFrame:
    """Repeated patterns ``pattern, ends, len`` longer than ``lower``.

    ``pattern`` is the state that opened the pattern; patterns are found in descending order of it.
    A pattern only collects states joined by suffix links, hence of one cluster, so each
    cluster is scanned on its own.
    """
    if index.longest > LIMIT:
        largest = cluster_sizes(index).agg(F.max("size")).first()[0]
        if largest > LIMIT:
            raise ValueError(f"pattern search holds one cluster per task; {largest} > {LIMIT} states")
    lower = max(lower, 0)
    keys = list(index.keys)
    st = index.with_next(index.frames.drop("trn"), next_sfx="sfx", next_lrs="lrs")
    after = F.expr(f"IF(next_sfx > 0 AND next_lrs > {lower}, next_sfx, -1)")
    packed = (
        together(st, *keys, "label").groupBy(*keys, "label")
        .agg(F.sort_array(F.collect_list(F.struct("state", "sfx", "lrs", after.alias("after")))).alias("s"))
        .where(F.expr(f"exists(s, x -> x.sfx > 0 AND x.lrs > {lower})"))
    )
    found = _scan_cluster(F.col("s.state"), F.col("s.sfx"), F.col("s.lrs"), F.col("s.after"), F.lit(lower))
    return packed.select(*keys, F.inline(found))


@F.arrow_udf(PATTERNS)
def _scan_cluster(
    states: pa.Array, sfx: pa.Array, lrs: pa.Array, after: pa.Array, lower: pa.Array
) -> pa.Array:
    shape = pa.list_(
        pa.struct([("pattern", pa.int32()), ("ends", pa.list_(pa.int32())), ("len", pa.int32())])
    )
    columns = (states, sfx, lrs, after, lower)
    return pa.array([_patterns(*row) for row in zip(*(c.to_pylist() for c in columns))], type=shape)


def _patterns(states, sfx, lrs, after, lower):
    """Patterns of one cluster, scanning its states from the last to the first."""
    repeat = dict(zip(states, lrs))
    children: dict[int, list[int]] = {}
    for i, s in zip(states, sfx):
        children.setdefault(s, []).append(i)
    patterns: list[dict] = []
    for i, s, n, nxt in sorted(zip(states, sfx, lrs, after), reverse=True):
        if s == 0 or n <= lower or i < lower + 2:
            continue
        home = next(
            (
                p
                for p in patterns
                if s in p["ends"] and not any(e - p["len"] < i < e for e in p["ends"])
            ),
            None,
        )
        if home is not None:
            home["ends"].append(i)
            home["len"] = min(home["len"], n)
        elif nxt - s != 1:
            later = children.get(i, [])
            size = min([n, *(repeat[j] for j in later)])
            if i - size + 1 < s:
                size = i - s
            if size > lower or not later:
                patterns.append({"pattern": i, "ends": [*later, i, s], "len": size})
    return patterns


def pattern_matrix(patterns: DataFrame, keys, compat: bool = False) -> DataFrame:
    """Cells ``pattern, pos`` that an occurrence covers; ``compat`` leaves out its last item."""
    size = F.col("len") - (1 if compat else 0)
    spans = patterns.where(size > 0).select(*keys, "pattern", size.alias("size"), "len", F.explode("ends").alias("e"))
    first = F.col("e") - F.col("len") + 1
    cells = spans.select(
        *keys, "pattern", F.explode(F.sequence(first, first + F.col("size") - 1)).alias("pos")
    )
    return cells.distinct()


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("end", T.IntegerType()), T.StructField("len", T.IntegerType())])))
def _fragment_chain(lrs: pa.Array) -> pa.Array:
    shape = pa.list_(pa.struct([("end", pa.int32()), ("len", pa.int32())]))
    return pa.array([_fragments(seq) for seq in lrs.to_pylist()], type=shape)


def _fragments(lrs):
    """Fragments of one sequence from its end; ``lrs[0]`` belongs to state 1.

    A fragment is the repeat of its last state, cut after the nearest earlier state with
    a longer repeat.
    """
    longer, stack = [], []  # nearest earlier state with a larger value
    for i, v in enumerate(lrs, 1):
        while stack and lrs[stack[-1] - 1] <= v:
            stack.pop()
        longer.append(stack[-1] if stack else 0)
        stack.append(i)
    out, end = [], len(lrs)
    while end > 0:
        size = max(1, min(lrs[end - 1], end - longer[end - 1]) if lrs[end - 1] > 1 else 1)
        out.append({"end": end, "len": size})
        end -= size
    return out


def find_fragments(index: Index, limit: int = LIMIT) -> DataFrame:
    """Backward fragments ``frag, end, len, link``.

    ``frag`` counts from the end of the sequence.  ``link`` belongs to the same fragment
    counted from the start: the number of the fragment ending at its earliest reverse
    suffix, shifted by its own place; 0 when there is none.
    """
    keys = list(index.keys)
    frags = _packed_fragments(index) if index.longest <= limit else _joined_fragments(index)
    child = index.frames.groupBy(*keys, F.col("sfx").alias("end")).agg(F.min("state").alias("to"))
    ends = frags.select(*keys, F.col("end").alias("to"), F.col("frag").alias("at"))
    linked = frags.join(child, [*keys, "end"], "left").join(ends, [*keys, "to"], "left")
    place = F.col("n") - 1 - F.col("frag")
    return linked.select(
        *keys, "frag", "end", "len", F.when(F.col("at") > 0, F.col("at") + place).otherwise(0).alias("link")
    )


def _packed_fragments(index: Index) -> DataFrame:
    keys = list(index.keys)
    packed = together(index.frames, *keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("state", "lrs"))).alias("s")
    )
    chain = packed.select(*keys, _fragment_chain("s.lrs").alias("c")).select(
        *keys, F.size("c").alias("n"), F.posexplode("c").alias("frag", "c")
    )
    return chain.select(*keys, "n", "frag", "c.end", "c.len")


def _joined_fragments(index: Index) -> DataFrame:
    """The same for sequences of any length: fragment sizes for all states, then the chain."""
    keys = list(index.keys)
    values = index.frames.select(*keys, F.col("state").alias("i"), F.col("lrs").alias("v"))
    seen = nearest_larger_before(values, keys, values.agg(F.max("v")).first()[0] or 1)
    size = F.when(F.col("v") > 1, F.least(F.col("v"), F.col("i") - F.col("before"))).otherwise(1)
    steps = cut(seen.select(*keys, F.col("i").alias("j"), size.alias("len"), (F.col("i") - size).alias("to")))
    last = steps.groupBy(*keys).agg(F.max("j").alias("j"))
    used = orbit(last, steps, keys, index.longest).withColumn("used", F.lit(1))
    marked = steps.join(used, [*keys, "j"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    ranked = index.running(marked, "j", sums={"rank": F.col("used")}).where("used = 1")
    count = ranked.groupBy(*keys).agg(F.max("rank").alias("n"))
    return ranked.join(count, keys).select(
        *keys, F.col("n").cast("int").alias("n"), (F.col("n") - F.col("rank")).cast("int").alias("frag"),
        F.col("j").alias("end"), "len",
    )
