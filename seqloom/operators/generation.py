"""New sequences from walks over an automaton, with reproducible draws."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import uniform
from ..sources.sequences import spread
from .automaton import Index


def jump_candidates(index: Index, lrs: int = 0, weight: str | None = None, prune: int = 0) -> DataFrame:
    """Where an improvisation may jump: ``label, phase, next, prob``.

    The choices at a state depend only on its cluster (and, with ``prune``, on its
    position modulo the beat), so they are kept once per cluster.
    """
    phase = F.col("state") % prune if prune else F.lit(0)
    able = index.frames.where((F.col("lrs") >= lrs) & (F.expr("size(trn) > 0"))).select(
        *index.keys, "label", phase.alias("phase"), (F.col("state") + 1).alias("next"), "lrs"
    )
    group = [*index.keys, "label", "phase"]
    totals = able.groupBy(*group).agg(F.sum("lrs").alias("w"), F.count(F.lit(1)).alias("n"))
    prob = 1 / F.col("n")
    if weight == "lrs":
        prob = F.when(F.col("w") > 0, F.col("lrs") / F.col("w")).otherwise(prob)
    return able.join(totals, group).select(*group, "next", prob.alias("prob"))


class Walker:
    """Link arrays of one automaton and the moves that generation makes on them."""

    def __init__(self, label, lrs, sfx, trn, seed):
        self.label, self.lrs, self.sfx, self.trn, self.seed = label, lrs, sfx, trn, seed
        self.last = len(sfx) - 1
        self.members: dict[int, list[int]] = {}
        self.children: list[list[int]] = [[] for _ in sfx]
        for s in range(1, len(sfx)):
            self.members.setdefault(label[s], []).append(s)
            self.children[sfx[s]].append(s)

    def pick(self, options, step, which=1):
        return options[int(uniform(self.seed, step, which) * len(options))]

    def jump(self, i, step, lrs=0, weight=None, prune=0):
        """One improvisation step from state ``i``."""
        able = [
            s
            for s in self.members[self.label[i]]
            if self.lrs[s] >= lrs and s < self.last and not (prune and (s - i) % prune)
        ]
        if not able:
            return 1 if i == self.last else i + 1
        if weight == "lrs":
            able = [s for s in able for _ in range(self.lrs[s])] or able
        return self.pick(able, step) + 1

    def improvise(self, size, k=1, lrs=0, weight=None, continuity=1, prune=0):
        """Jumps, each followed by ``continuity`` states in their order when they fit."""
        out: list[int] = []

        def straight(k):
            if k + continuity < self.last:
                out.extend(range(k, k + continuity))
                return continuity
            return 0

        left = size - straight(k)
        k, step = out[-1] if out else k, 0
        while left > 0:
            out.append(self.jump(k, step, lrs, weight, prune))
            nxt = out[-1] + 1
            left -= 1 + straight(nxt if nxt < self.last else 1)
            k, step = out[-1], step + 1
        return out, k, []

    def relatives(self, k):
        """States reachable over suffix links: the chain of ``k`` and all its children."""
        found = {0}
        while k > 0:
            found.update(self.children[k])
            found.add(self.sfx[k])
            k = self.sfx[k]
        return sorted(found)

    def generate(self, size, p=0.5, k=1, lrs=0, weight=None):
        """Forward links with probability ``p``, else a jump over suffix links."""
        out, trace = [], [1]
        for step in range(size):
            if k == 0 or self.sfx[k] == 0:
                k = k + 1 if k < self.last else self.sfx[k] + 1
                out.append(k)
            elif uniform(self.seed, step, 0) < p:
                if not self.trn[k]:
                    k = self.sfx[k]
                    trace.append(k)
                k = self.pick(self.trn[k], step)
                out.append(k)
            else:
                trace.append(k)
                options = [s for s in self.relatives(k) if self.lrs[s] >= lrs]
                if not options:
                    k = k + 1 if k < self.last else self.sfx[k] + 1
                    out.append(k)
                else:
                    s = self._choose(options, step, weight)
                    if s == self.last:  # nothing follows the last state: skip ahead silently
                        k = self.sfx[s] + 2
                    else:
                        k = s + 1
                        out.append(k)
            trace.append(k)
            if k >= self.last:
                k = 0
        return out, k, trace

    def _choose(self, options, step, weight):
        if weight == "max":
            return max(options, key=lambda s: self.lrs[s])
        if weight == "weight":
            top = max(self.lrs[s] for s in options)
            target = top - math.floor(-math.log(1.0 - uniform(self.seed, step, 2)))
            gap = min(abs(self.lrs[s] - target) for s in options)
            near = [s for s in options if abs(self.lrs[s] - target) == gap]
            return self.pick(near, step) if gap == 0 else near[0]
        return self.pick(options, step)


_WALK = T.StructType(
    [
        T.StructField("states", T.ArrayType(T.IntegerType())),
        T.StructField("last", T.IntegerType()),
        T.StructField("trace", T.ArrayType(T.IntegerType())),
    ]
)


def _walks(index: Index, seeds: DataFrame, move: str, options: dict) -> DataFrame:
    @F.arrow_udf(_WALK)
    def walk(label: pa.Array, lrs: pa.Array, sfx: pa.Array, trn: pa.Array, seed: pa.Array) -> pa.Array:
        rows = []
        for row in zip(*(c.to_pylist() for c in (label, lrs, sfx, trn, seed))):
            out, last, trace = getattr(Walker(*row), move)(**options)
            rows.append({"states": out, "last": last, "trace": trace})
        lists = pa.list_(pa.int32())
        return pa.array(rows, type=pa.struct([("states", lists), ("last", pa.int32()), ("trace", lists)]))

    index.require_bounded("generation")
    packed = index.states.groupBy(*index.keys).agg(
        F.sort_array(F.collect_list(F.struct("state", "label", "lrs", "sfx", "trn"))).alias("m")
    )
    return spread(packed.join(seeds, list(index.keys)), *index.keys, "seed").select(
        *index.keys, "seed", walk("m.label", "m.lrs", "m.sfx", "m.trn", "seed").alias("w")
    )


def improvise(index: Index, seeds: DataFrame, size: int, **options) -> DataFrame:
    """Improvised states ``seed, step, state``; ``seeds`` has the automaton keys and ``seed``.

    Options: ``k`` (start), ``lrs``, ``weight`` (None or ``lrs``), ``continuity``, ``prune``.
    """
    walks = _walks(index, seeds, "improvise", {"size": size, **options})
    return _steps(index, walks)


def generate(index: Index, seeds: DataFrame, size: int, **options) -> DataFrame:
    """Generated states ``seed, step, state``; a jump to the last state emits nothing.

    Options: ``p``, ``k`` (start), ``lrs``, ``weight`` (None, ``max`` or ``weight``).
    """
    return _steps(index, _walks(index, seeds, "generate", {"size": size, **options}))


def generation_trace(index: Index, seeds: DataFrame, size: int, **options) -> DataFrame:
    """The last state and the states visited on the way: ``seed, last, step, state``."""
    walks = _walks(index, seeds, "generate", {"size": size, **options})
    return walks.select(*index.keys, "seed", "w.last", F.posexplode("w.trace").alias("step", "state"))


def _steps(index: Index, walks: DataFrame) -> DataFrame:
    return walks.select(*index.keys, "seed", F.posexplode("w.states").alias("step", "state"))
