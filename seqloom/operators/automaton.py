"""The automaton table: one row per state, built in parallel over sequences.

``build_index`` decides by a count per sequence: sequences of at most ``limit`` items
are packed into one row each and linked inside an Arrow task; longer ones go through
the join rounds of :mod:`seqloom.operators.rounds`, whose tasks never hold a sequence.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scan import running, with_next
from ..session import cut
from ..sources import sequences
from .links import link_frames, link_symbols, sweep_frames

LIMIT = 100_000  # items of one sequence that a single task may hold
STEPS = 16  # consecutive thresholds that one task sweeps

INTS = ("state", "sfx", "lrs", "label", "prev_label", "word", "word_end")
STATES = T.ArrayType(
    T.StructType(
        [T.StructField(c, T.IntegerType()) for c in INTS]
        + [T.StructField("trn", T.ArrayType(T.IntegerType()))]
    )
)

RUNS = T.ArrayType(
    T.StructType(
        [
            T.StructField("threshold", T.DoubleType()),
            T.StructField("members", T.ArrayType(T.DoubleType())),
            T.StructField("states", STATES),
        ]
    )
)


@dataclass(frozen=True)
class Index:
    """States of many automata.

    ``states`` has ``keys`` plus ``state, sfx, lrs, label, prev_label, word, word_end, trn``:
    ``label`` numbers the clusters by first appearance, ``word``/``word_end`` bound the
    parsed word (``word < state <= word_end``) and ``trn`` lists the forward links.
    It is a written table, so its many readers do not link the sequences again.
    State 0 has a null suffix and label.  ``longest`` is the largest state number;
    ``sources`` are the sequences the table came from.
    """

    states: DataFrame
    keys: tuple[str, ...]
    longest: int
    sources: DataFrame | None = None
    params: tuple = ()

    @property
    def frames(self) -> DataFrame:
        """The states that stand for items (all but state 0)."""
        return self.states.where("state > 0")

    def running(self, df: DataFrame, order: str = "state", sums=None, maxes=None) -> DataFrame:
        """Running aggregates per automaton, in blocks when a sequence is long."""
        return running(df, self.keys, order, self.longest, sums, maxes)

    def with_next(self, df: DataFrame, **cols) -> DataFrame:
        """Columns of the following state beside each state."""
        return with_next(df, self.keys, "state", self.longest, **cols)

    def require_bounded(self, what: str) -> None:
        """Refuse to put a long sequence into one task."""
        if self.longest > LIMIT:
            raise ValueError(f"{what} holds one sequence per task; {self.longest} > {LIMIT} states")

    def links(self) -> DataFrame:
        """Forward links as rows ``src -> dst``."""
        return self.states.select(*self.keys, F.col("state").alias("src"), F.explode("trn").alias("dst"))

    def suffix_links(self) -> DataFrame:
        """Suffix links as rows ``src -> dst``; read backwards they are the reverse links."""
        return self.frames.select(*self.keys, F.col("state").alias("src"), F.col("sfx").alias("dst"))


def build_index(
    seqs: DataFrame,
    kind: str = "symbolic",
    threshold=0.0,
    metric="euclidean",
    method: str = "inc",
    limit: int = LIMIT,
    longest: int | None = None,
) -> Index:
    """Index sequences of symbols (``symbolic``) or frames (``variable``).

    ``threshold`` is a number, a list of numbers to build one automaton for each, or a
    frame ``seq_id, threshold`` with a number per sequence.
    ``method`` is ``inc`` (first suffix with a match) or ``complete`` (whole chain).
    ``longest`` skips the length check when the caller knows a bound.
    """
    kind = {"f": "symbolic", "a": "variable", "v": "variable"}.get(kind, kind)
    if kind not in ("symbolic", "variable"):
        raise ValueError(f"unknown kind {kind!r}")
    if longest is None:
        longest = sequences.lengths(seqs).agg(F.max("n")).first()[0] or 0
    sweep = isinstance(threshold, (list, tuple))
    keys = ("seq_id", "threshold") if sweep else ("seq_id",)
    params = (kind, threshold, metric, method)
    if longest <= limit:
        return Index(cut(_packed(seqs, keys, *params)), keys, longest, seqs, params)

    from .rounds import link_by_rounds

    sized = seqs.join(sequences.lengths(seqs), "seq_id")
    short, long = (sized.where(c).drop("n") for c in (F.col("n") <= limit, F.col("n") > limit))
    states = _packed(short, keys, *params).unionByName(link_by_rounds(long, keys, *params))
    return Index(cut(states), keys, longest, seqs, params)


def build_sweep(
    seqs: DataFrame, grid, metric: str = "euclidean", method: str = "inc", limit: int = LIMIT
) -> tuple[Index, DataFrame]:
    """Automata of frames for every threshold of a grid, equal ones built once.

    The index is keyed by ``seq_id`` and the lowest ``threshold`` of a run of grid values
    with the same links; ``seq_id, threshold, member`` maps every grid value to its run.
    A pass over ascending thresholds links anew only where a distance is crossed.
    """
    grid = sorted({float(t) for t in grid})
    keys, params = ("seq_id", "threshold"), ("variable", grid, metric, method)
    sizes = sequences.lengths(seqs)
    longest = sizes.agg(F.max("n")).first()[0] or 0
    steps = [grid[i : i + STEPS] for i in range(0, len(grid), STEPS)]
    if not steps:
        raise ValueError("a sweep needs thresholds")
    short = seqs if longest <= limit else seqs.join(sizes.where(F.col("n") <= limit), "seq_id").drop("n")
    asked = F.explode(F.array(*[F.array(*[F.lit(t) for t in part]) for part in steps])).alias("asked")
    packed = sequences.pack(short).select("seq_id", asked, "items")
    packed = sequences.spread(packed, "seq_id", "asked")
    runs = packed.select("seq_id", F.inline(frame_runs(metric, method)("items", "asked")))
    first = F.when(F.col("s.state") == 0, F.col("members")).alias("members")  # once per automaton
    states = runs.select("seq_id", "threshold", "members", F.explode("states").alias("s")).select(*keys, first, "s.*")
    if longest > limit:
        from .rounds import link_by_rounds

        long = link_by_rounds(seqs.join(sizes.where(F.col("n") > limit), "seq_id").drop("n"), keys, *params)
        own = F.when(F.col("state") == 0, F.array("threshold")).alias("members")
        states = states.unionByName(long.select("*", own))
    states = cut(states)
    members = states.where("state = 0").select(*keys, F.explode("members").alias("member"))
    return Index(states.drop("members"), keys, longest, seqs, params), members


def _packed(seqs, keys, kind, threshold, metric, method) -> DataFrame:
    packed = sequences.pack(seqs)
    if kind == "symbolic":
        linked = symbol_links("items")
    elif isinstance(threshold, DataFrame):
        packed = packed.join(threshold.select("seq_id", "threshold"), "seq_id")
        linked = frame_links(metric, method)("items", "threshold")
    elif "threshold" in keys:
        grid = F.explode(F.array(*[F.lit(float(t)) for t in threshold]))
        packed = packed.select("seq_id", grid.alias("threshold"), "items")
        packed = sequences.together(packed, "seq_id", "threshold")
        linked = frame_links(metric, method)("items", "threshold")
    else:
        linked = frame_links(metric, method)("items", F.lit(float(threshold)))
    return packed.select(*keys, F.inline(linked))


@F.arrow_udf(STATES)
def symbol_links(items: pa.Array) -> pa.Array:
    return _state_arrays(link_symbols(seq.as_py()) for seq in items)


def frame_links(metric, method):
    @F.arrow_udf(STATES)
    def links(items: pa.Array, thresholds: pa.Array) -> pa.Array:
        return _state_arrays(
            link_frames(_matrix(frames), t.as_py(), metric, method == "complete")
            for frames, t in zip(items, thresholds)
        )

    return links


def frame_runs(metric, method):
    """Runs of ascending thresholds with the states they share."""

    @F.arrow_udf(RUNS)
    def runs(items: pa.Array, asked: pa.Array) -> pa.Array:
        members, linked, ends = [], [], [0]
        for frames, thresholds in zip(items, asked):
            for own, links in sweep_frames(_matrix(frames), thresholds.as_py(), metric, method == "complete"):
                members.append(own)
                linked.append(links)
            ends.append(len(members))
        lowest = pa.array([own[0] for own in members], pa.float64())
        columns = [lowest, pa.array(members, pa.list_(pa.float64())), _state_arrays(linked)]
        rows = pa.StructArray.from_arrays(columns, names=["threshold", "members", "states"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return runs


def _matrix(frames: pa.ListScalar):
    flat = frames.values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(frames.values), -1)


def _state_arrays(linked) -> pa.Array:
    """Links of several sequences as one Arrow array of state lists (-1 stands for null)."""
    cols = {c: array("i") for c in INTS}
    offsets, trn, trn_ends = array("i", [0]), array("i"), array("i", [0])
    for seq in linked:
        n = len(seq["sfx"])
        cols["state"].extend(range(n))
        cols["prev_label"].append(-1)
        cols["prev_label"].extend(seq["label"][:-1])
        for c in ("sfx", "lrs", "label", "word", "word_end"):
            cols[c].extend(seq[c])
        for targets in seq["trn"]:
            trn.extend(targets)
            trn_ends.append(len(trn))
        offsets.append(offsets[-1] + n)
    arrays = [pa.array(v, pa.int32(), mask=v < 0) for v in map(_ints, cols.values())]
    arrays.append(pa.ListArray.from_arrays(pa.array(_ints(trn_ends)), pa.array(_ints(trn))))
    rows = pa.StructArray.from_arrays(arrays, names=[*cols, "trn"])
    return pa.ListArray.from_arrays(pa.array(_ints(offsets)), rows)


def _ints(values: array) -> np.ndarray:
    return np.array(values, dtype=np.int32)


def save_index(index: Index, path: str) -> None:
    """Write the states, the sequences they came from and the parameters as parquet below ``path``.

    A metric that is a function cannot be saved; give it again when reading.
    """
    spark = index.states.sparkSession
    index.states.write.mode("overwrite").parquet(f"{path}/states")
    if index.sources is not None:
        index.sources.write.mode("overwrite").parquet(f"{path}/sources")
    kind, threshold, metric, method = index.params or ("symbolic", 0.0, "euclidean", "inc")
    own = isinstance(threshold, DataFrame)
    if own:
        threshold.select("seq_id", "threshold").write.mode("overwrite").parquet(f"{path}/thresholds")
    plain = [] if own else [float(t) for t in threshold] if isinstance(threshold, (list, tuple)) else [float(threshold)]
    sweep = isinstance(threshold, (list, tuple))
    row = (kind, None if callable(metric) else metric, method, plain, sweep, own, index.longest, index.sources is not None)
    spark.createDataFrame([row], PARAMETERS).write.mode("overwrite").parquet(f"{path}/parameters")


PARAMETERS = (
    "kind string, metric string, method string, thresholds array<double>, sweep boolean, own boolean, "
    "longest int, with_sources boolean"
)


def read_index(spark: SparkSession, path: str, metric=None) -> Index:
    """The index that ``save_index`` wrote, complete enough to build on."""
    states = spark.read.parquet(f"{path}/states")
    p = spark.read.schema(PARAMETERS).parquet(f"{path}/parameters").first()
    threshold = p.thresholds if p.sweep else spark.read.parquet(f"{path}/thresholds") if p.own else p.thresholds[0]
    keys = tuple(c for c in ("seq_id", "threshold") if c in states.columns)
    sources = spark.read.parquet(f"{path}/sources") if p.with_sources else None
    return Index(states, keys, p.longest, sources, (p.kind, threshold, metric or p.metric, p.method))
