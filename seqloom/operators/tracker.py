"""Following a live observation stream through a model, one frame per observation.

A model is fitted per sequence (threshold by information rate, order-0 transitions,
cluster medians).  The same small step runs over packed sequences here and inside the
stateful streaming operator of :mod:`seqloom.streaming.live`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from ..sources import sequences
from . import maxplus
from .automaton import LIMIT, build_index
from .hmm import EPS, by_length, cluster_medians, hmm_tensor, log_transitions
from .rate import find_threshold, threshold_grid

MODEL = ("n_labels", "med", "cells", "label")


def fit(seqs: DataFrame, grid=None, metric: str = "cosine", limit: int = LIMIT) -> DataFrame:
    """One model per sequence: ``seq_id, threshold, n_labels, med, cells, label``.

    ``med`` holds the cluster medians row by row, ``cells`` the transition cells and
    ``label`` the cluster of every state.
    """
    grid = threshold_grid(0.0, 1.0, 0.001) if grid is None else grid
    best = find_threshold(seqs, grid, metric=metric).select("seq_id", "threshold")
    index = build_index(seqs, "variable", best, metric, limit=limit)
    med = cluster_medians(index, seqs, limit).groupBy("seq_id").agg(
        F.sort_array(F.collect_list(F.struct("label", "dim", "med"))).alias("m")
    )
    cells = hmm_tensor(index, 1).groupBy("seq_id").agg(
        F.sort_array(F.collect_list(F.struct("from", "to", "prob", "unseen"))).alias("cells")
    )
    labels = index.frames.groupBy("seq_id").agg(
        F.sort_array(F.collect_list(F.struct("state", "label"))).alias("s"),
        (F.max("label") + 1).alias("n_labels"),
    )
    return (
        labels.join(med, "seq_id").join(cells, "seq_id", "left").join(best, "seq_id")
        .select("seq_id", "threshold", "n_labels", F.col("m.med").alias("med"), "cells",
                F.col("s.label").alias("label"))
    )


class Follower:
    """Scores and current frame of one observation stream on one model.

    ``predicted`` takes the cluster that the transitions favour before the new
    observation is weighed in (the first cluster at the start); ``observed`` takes the
    best cluster after it.
    """

    def __init__(self, n_labels, med, cells, label, decay=1.0, rule="predicted", v=None, frame=0):
        if rule not in ("predicted", "observed"):
            raise ValueError(f"unknown rule {rule!r}")
        self.med = np.array(med, dtype=float).reshape(n_labels, -1)
        self.log_a = log_transitions(n_labels, cells)
        label = np.array(label)
        self.members = np.split(np.argsort(label, kind="stable") + 1, np.cumsum(np.bincount(label, minlength=n_labels))[:-1])
        self.decay, self.rule = decay, rule
        self.v = None if v is None else np.array(v, dtype=float)
        self.frame = frame  # state number; 0 before the first observation

    def observe(self, x) -> int:
        """The frame (from 0) for the next observation."""
        x = np.asarray(x, dtype=float)
        with np.errstate(invalid="ignore", divide="ignore"):
            apart = 1.0 - self.med @ x / (np.linalg.norm(self.med, axis=1) * np.linalg.norm(x))
        emit = np.log((2.0 - apart + EPS) / 2.0)
        if self.v is None:
            self.v = emit - np.log(len(self.med))
            cluster = 0 if self.rule == "predicted" else int(self.v.argmax())
            self.frame = int(self.members[cluster][0])
            return self.frame - 1
        step = (self.decay * self.v[:, None] + self.log_a).max(axis=0)
        self.v = step + emit
        cluster = int((step if self.rule == "predicted" else self.v).argmax())
        self.frame = _moved(self.members[cluster], self.frame)
        return self.frame - 1


def _moved(members: np.ndarray, frame: int) -> int:
    """The next frame where the cluster has it, else its nearest one; the earlier of two."""
    at = int(np.searchsorted(members, frame + 1))
    if at < len(members) and members[at] == frame + 1:
        return frame + 1
    near = members[max(at - 1, 0) : at + 1]
    return int(near[np.abs(near - frame).argmin()])


def track(models: DataFrame, obs: DataFrame, decay: float = 1.0, rule: str = "predicted", limit: int = LIMIT) -> DataFrame:
    """Frames ``seq_id, t, frame`` of every observation sequence on the model of its id.

    Sequences of more than ``limit`` observations are scored in blocks (:mod:`maxplus`).
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def follow(n_labels: pa.Array, med: pa.Array, cells: pa.Array, label: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for *model, seq in zip(*(c.to_pylist() for c in (n_labels, med, cells, label, items))):
            follower = Follower(*model, decay=decay, rule=rule)
            out.append([follower.observe(x) for x in seq])
        return pa.array(out, type=pa.list_(pa.int32()))

    short, long = by_length(obs, limit)
    packed = sequences.pack(short)
    frames = sequences.spread(packed.join(models, "seq_id"), "seq_id").select(
        "seq_id", F.posexplode(follow(*MODEL, "items")).alias("i", "frame")
    )
    frames = frames.select("seq_id", (F.col("i") + 1).alias("t"), "frame")
    return frames if long is None else frames.unionByName(_in_blocks(long, models, decay, rule))


def closeness(n_labels: int, med, items) -> np.ndarray:
    """Log emissions from the angles between observations and medians."""
    med, x = np.array(med, dtype=float).reshape(n_labels, -1), np.array(items, dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        apart = 1.0 - x @ med.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(med, axis=1))
    return np.log((2.0 - apart + EPS) / 2.0)


def _in_blocks(obs: DataFrame, models: DataFrame, decay: float, rule: str) -> DataFrame:
    """The clusters of all blocks at once, then the frames in one pass over the clusters."""
    if rule not in ("predicted", "observed"):
        raise ValueError(f"unknown rule {rule!r}")
    blocks = cut(maxplus.in_blocks(obs, models.select("seq_id", *MODEL)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, emit = maxplus.Transitions(r["n_labels"], r["cells"]), closeness(r["n_labels"], r["med"], r["items"])
                v, chosen = r["v"], []
                for e in emit:
                    if v is None:
                        v = e - np.log(a.n)
                        chosen.append(0 if rule == "predicted" else int(v.argmax()))
                        continue
                    step = a.step(decay * np.array(v)[None])[0]
                    v = step + e
                    chosen.append(int((step if rule == "predicted" else v).argmax()))
                label = r["label"] if r["block"] == 0 else None
                rows = {"seq_id": [r["seq_id"]], "block": [r["block"]], "chosen": [chosen], "label": [label]}
                yield maxplus.records(batch, rows, chosen=_INTS, label=_INTS)

    key = f"seq_id {obs.schema['seq_id'].dataType.simpleString()}"
    started = blocks.join(maxplus.incoming(blocks, closeness, decay), ["seq_id", "block"])
    chosen = sequences.spread(started, "seq_id", "block").mapInArrow(
        choose, f"{key}, block int, chosen array<int>, label array<int>"
    )
    ordered = cut(chosen).repartition("seq_id").sortWithinPartitions("seq_id", "block")
    return ordered.mapInArrow(_frames, f"{key}, t int, frame int")


_INTS = pa.list_(pa.int32())


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One frame per observation: the next one where its cluster is chosen, else the nearest."""
    frame, t, members = 0, 0, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["block"] == 0:
                label = np.array(r["label"])
                order = np.argsort(label, kind="stable")
                members = np.split(order + 1, np.cumsum(np.bincount(label))[:-1])
                frame, t = 0, 0
            out = []
            for c in r["chosen"]:
                frame = int(members[c][0]) if frame == 0 else _moved(members[c], frame)
                out.append(frame - 1)
            times = np.arange(t + 1, t + len(out) + 1, dtype=np.int32)
            t += len(out)
            ids = pa.array([r["seq_id"]] * len(out), batch.schema.field("seq_id").type)
            columns = [ids, pa.array(times), pa.array(out, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["seq_id", "t", "frame"])
