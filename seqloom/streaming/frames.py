"""Automata of frame streams: links that grow with every frame, searched through pivots.

A new frame is compared with forward targets of the states on its suffix chain.  The first
frames of a key are its pivots, and every target is filed under its state and the slot
of its distance to the first pivot, in slots as wide as the threshold.  By the triangle
inequality a match lies in the frame's slot or beside it, and its distances to the other
pivots differ by less than the threshold, so only targets that pass both are read and measured.

All of it is map state, in chunks of bounded size: a step reads the slots it needs, and an
automaton may be far larger than a task's memory.  Metrics without a triangle inequality
(``canberra``, ``braycurtis``, functions) have one slot, so all targets are measured.
Frames with components that are not finite, and zero frames of an angle, match nothing.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from ..functions.distance import as_length, measuring
from ..operators.links import add_state
from .live import STATE_ROWS, Buckets, Cells, InOrder, bucket_map, in_order, ints, link_maps

PIVOTS = 4  # frames of a key that all later ones are measured against
CHUNK = 64  # targets of one map entry
FRAME_ROWS = T.StructType([*STATE_ROWS, T.StructField("measured", T.LongType())])

_SLOT = T.StructType([T.StructField("state", T.IntegerType()), T.StructField("slot", T.LongType())])
_PART = T.StructType([*_SLOT, T.StructField("part", T.IntegerType())])
_TARGETS = T.StructType(
    [T.StructField("t", T.ArrayType(T.IntegerType())), T.StructField("apart", T.ArrayType(T.DoubleType()))]
)
_THRESHOLD = T.StructType([T.StructField("threshold", T.DoubleType())])


class Targets:
    """Forward targets of the states of one key, found by their distances to the pivots."""

    def __init__(self, cells: dict[str, Cells], metric, threshold: float):
        self.frame, self.filled, self.part, self.pivot = (cells[c] for c in ("frame", "filled", "part", "pivot"))
        self.prepare, self.measure = measuring(metric)
        self.length = as_length(metric)
        self.threshold, self.measured = threshold, 0
        if self.length is not None:  # rounding must not put a match out of reach
            self.reach = float(self.length(max(threshold, 0.0))) * (1 + 1e-6) + 1e-9

    def enter(self, i: int, frame) -> None:
        """Make ``frame`` the current one, as state ``i``."""
        self.x = self.prepare(frame)
        self.frame[i] = self.x
        self.apart = np.full(PIVOTS, np.nan)
        self.matches = self.length is None or bool(np.isfinite(self.x).all())
        if self.length is None or not self.matches:
            return
        for p in range(PIVOTS):
            pivot = self.pivot.get(p)
            if pivot is None:
                self.pivot[p] = pivot = self.x
                self.apart[p] = 0.0
                return
            self.measured += 1
            self.apart[p] = self.length(self.measure(self.x, np.asarray(pivot)[None]))[0]

    def slot(self) -> int:
        return 0 if self.length is None else math.floor(self.apart[0] / self.reach)

    def link(self, k: int, i: int) -> None:
        """File the current frame under state ``k``."""
        if not self.matches:
            return
        at = (k, self.slot())
        n = self.filled.get(at) or 0
        t, apart = self.part.get((*at, n // CHUNK)) or ([], [])
        self.part[(*at, n // CHUNK)] = ([*t, i], [*apart, *self.apart.tolist()])
        self.filled[at] = n + 1

    def hit(self, k: int, i: int):
        """The nearest target of ``k`` below the threshold, as (distance, state)."""
        if not self.matches:
            return None
        here, best = self.slot(), None
        for slot in (0,) if self.length is None else (here - 1, here, here + 1):
            for part in range(-(-(self.filled.get((k, slot)) or 0) // CHUNK)):
                states, apart = self.part.get((k, slot, part))
                states, apart = np.asarray(states), np.asarray(apart).reshape(-1, PIVOTS)
                if self.length is not None:
                    states = states[~(np.abs(apart - self.apart) >= self.reach).any(axis=1)]
                if not len(states):
                    continue
                self.measured += len(states)
                d = self.measure(self.x, np.array([self.frame.get(int(t)) for t in states], dtype=float))
                for j in np.flatnonzero(d < self.threshold):
                    found = (float(d[j]), int(states[j]))
                    best = found if best is None else min(best, found)
        return best


class _GrowFrames(InOrder):
    """State: links and counters of the key's automaton, its frames, pivots and filed targets."""

    def __init__(self, order: str | list[str], timed: bool, threshold: float | None, metric, exhaustive: bool):
        super().__init__(order, T.ArrayType(T.DoubleType()), timed)
        self.threshold, self.metric, self.exhaustive = threshold, metric, exhaustive

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.size = handle.getValueState("size", ints("n", "fresh"))
        self.own = handle.getValueState("own", _THRESHOLD)
        self.maps = link_maps(handle)
        self.vectors = {n: bucket_map(handle, n, ints("state"), T.ArrayType(T.DoubleType())) for n in ("frame", "pivot")}
        self.filled = bucket_map(handle, "filled", _SLOT)
        self.part = handle.getMapState("part", _PART, _TARGETS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.own.update((float(initialState.iloc[0]["threshold"]),))

    def take(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        threshold = self.own.get()[0] if self.own.exists() else self.threshold
        if threshold is None:
            raise ValueError(f"no threshold for stream {key[0]!r}")
        n, fresh = self.size.get() if self.size.exists() else (0, 0)
        new = n == 0
        cells = {name: Buckets(state, int, new=new) for name, state in self.maps.items()}
        for name, state in self.vectors.items():
            cells[name] = Buckets(state, lambda x: [float(v) for v in x], new=new)
        cells["filled"] = Buckets(self.filled, int, new=new)
        cells["part"] = Cells(self.part, pack=lambda v: v, unpack=lambda v: v, new=new)
        sfx, lrs, label, twin = (cells[c] for c in ("sfx", "lrs", "label", "twin"))
        targets = Targets(cells, self.metric, threshold)
        if n == 0:
            sfx[0], lrs[0], label[0] = -1, 0, -1
        out = []
        for item in batch["item"]:
            n, before = n + 1, targets.measured
            targets.enter(n, item)
            if add_state(n, fresh, label, sfx, lrs, twin, targets.hit, targets.link, self.exhaustive):
                fresh += 1
            out.append((key[0], n, sfx[n], lrs[n], label[n], targets.measured - before))
        for c in cells.values():
            c.flush()
        self.size.update((n, fresh))
        return pd.DataFrame(out, columns=FRAME_ROWS.names)


def grow_frames(
    stream: DataFrame,
    threshold: float | DataFrame,
    metric="euclidean",
    order: str | list[str] = "pos",
    method: str = "inc",
    event_time: str | None = None,
) -> DataFrame:
    """Index frame streams ``seq_id, <order>, item`` as they arrive: one row per new state.

    ``threshold`` is a number or a frame ``seq_id, threshold``, which enters the state store as
    initial state.  ``measured`` counts the distances that a step computed.  ``order`` is one column
    or a list of them; with ``event_time`` rows wait for the watermark (:mod:`seqloom.streaming.live`).
    """
    own = isinstance(threshold, DataFrame)
    timed = event_time is not None
    step = _GrowFrames(order, timed, None if own else float(threshold), metric, method == "complete")
    initial = threshold.select("seq_id", "threshold").groupBy("seq_id") if own else None
    keyed = in_order(stream, event_time).groupBy("seq_id")
    return keyed.transformWithStateInPandas(step, FRAME_ROWS, "append", "eventTime" if timed else "none", initialState=initial)
