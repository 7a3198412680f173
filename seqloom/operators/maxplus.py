"""Best-path scores along long observation sequences, by max-plus products of blocks.

A score vector goes through one observation as ``v'[j] = max_i(decay * v[i] + A[i, j]) + e[j]``.
Observations are dealt out in blocks.  What a block does to any incoming vector is a matrix,
``v'[j] = max_i(decay**n * v[i] + P[i, j])``, so all blocks find theirs at the same time, a
slice of rows per task.  One light pass over the matrices in order then gives every block
its incoming vector, and all blocks run once more from there.

``A`` is kept as its stored cells and one constant per row for all others: a stored cell is never
below the constant, so the best predecessor is the best stored one or the best row constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sequences

EPS = np.finfo(float).eps
BLOCK = 1024  # observations of a block
STARTS = 64  # rows of a block's matrix that a task makes at once


class Transitions:
    """Log probabilities of one model: ``to``-ordered cells and a constant per row."""

    def __init__(self, n_labels: int, cells, smooth: float = 1.0):
        got = sorted((c["to"], c["from"], c["prob"]) for c in cells or [])
        to, self.source, prob = (np.array(x) for x in (zip(*got) if got else ((), (), ())))
        self.source = self.source.astype(int)
        unseen = np.zeros(n_labels)
        for c in cells or []:
            unseen[c["from"]] = c["unseen"]
        add = EPS + smooth
        total = n_labels * (unseen + add) + np.bincount(self.source, prob - unseen[self.source] if got else None, n_labels)
        self.rest = np.log((unseen + add) / total)
        self.cell = np.log((prob.astype(float) + add) / total[self.source])
        self.to, self.first = np.unique(to.astype(int), return_index=True)
        self.n = n_labels

    def step(self, u: np.ndarray) -> np.ndarray:
        """``max_i(u[:, i] + A[i, j])`` for every row of ``u``."""
        out = np.repeat((u + self.rest).max(axis=1)[:, None], self.n, axis=1)
        if len(self.to):
            best = np.maximum.reduceat(u[:, self.source] + self.cell, self.first, axis=1)
            out[:, self.to] = np.maximum(out[:, self.to], best)
        return out

    def best(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The step of one vector, and the smallest label that reaches it."""
        out = self.step(v[None])[0]
        common = v + self.rest
        back = np.full(self.n, int(common.argmax()))
        if len(self.to):
            ends = np.append(self.first[1:], len(self.source))
            sums = v[self.source] + self.cell
            for j, a, b in zip(self.to, self.first, ends):
                at = a + int(sums[a:b].argmax())
                if sums[at] > common[back[j]] or (sums[at] == common[back[j]] and self.source[at] < back[j]):
                    back[j] = self.source[at]
        return out, back


def in_blocks(obs: DataFrame, models: DataFrame, block: int = BLOCK) -> DataFrame:
    """Observations ``seq_id, block, items, last`` beside the model of their sequence."""
    numbered = sequences.number(obs).withColumn("block", F.floor((F.col("pos") - 1) / block).cast("int"))
    packed = numbered.groupBy("seq_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("p"))
    last = packed.groupBy("seq_id").agg(F.max("block").alias("end"))
    packed = packed.join(last, "seq_id").select("seq_id", "block", F.col("p.item").alias("items"), (F.col("block") == F.col("end")).alias("last"))
    return packed.join(models, "seq_id")


def incoming(blocks: DataFrame, emit, decay: float = 1.0) -> DataFrame:
    """``seq_id, block, v``: the scores before every block; null before the first.

    ``blocks`` has ``n_labels, med, cells`` and what ``emit(n_labels, med, items)`` needs to give
    the log emissions, a row per observation.
    """

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                e, a = emit(r["n_labels"], r["med"], r["items"]), Transitions(r["n_labels"], r["cells"])
                if r["block"] == 0:
                    u = (e[0] - np.log(a.n))[None]
                else:
                    u = np.full((r["size"], a.n), -np.inf)
                    u[np.arange(r["size"]), r["start"] + np.arange(r["size"])] = 0.0
                    u = a.step(u) + e[0]
                for row in e[1:]:
                    u = a.step(decay * u) + row
                out = {"seq_id": [r["seq_id"]], "block": [r["block"]], "start": [r["start"]], "weight": [decay ** len(e)], "p": [u.ravel()]}
                yield records(batch, out, start=pa.int32(), weight=pa.float64(), p=pa.list_(pa.float64()))

    key = f"seq_id {blocks.schema['seq_id'].dataType.simpleString()}"
    starts = F.explode(F.when(F.col("block") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n_labels") - 1, F.lit(STARTS))))
    asked = blocks.where("NOT last").select("*", starts.alias("start"))
    asked = asked.withColumn("size", F.least(F.lit(STARTS), F.col("n_labels") - F.col("start")))
    made = sequences.spread(asked, "seq_id", "block", "start").mapInArrow(
        matrices, f"{key}, block int, start int, weight double, p array<double>"
    )
    ordered = made.repartition("seq_id").sortWithinPartitions("seq_id", "block", "start")
    after = ordered.mapInArrow(_chain, f"{key}, block int, v array<double>")
    first = blocks.where("block = 0").select("seq_id", "block", F.lit(None).cast("array<double>").alias("v"))
    return first.unionByName(after)


def records(source: pa.RecordBatch, columns: dict, **types) -> pa.RecordBatch:
    """A batch of sequences and blocks, ids as in ``source``."""
    kinds = {"seq_id": source.schema.field("seq_id").type, "block": pa.int32(), **types}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in kinds.items()], names=list(kinds))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores after each block from those before it; holds one vector and one slice of a matrix."""
    at, v, part, n = None, None, None, 0
    for batch in batches:
        done = {"seq_id": [], "block": [], "v": []}
        for r in batch.to_pylist():
            if r["block"] == 0:  # a new sequence: its first block is a vector already
                v, part, at = None, np.array(r["p"]), (r["seq_id"], 0)
                n = len(part)
            else:
                if at != (r["seq_id"], r["block"]):
                    v, part, at = part, np.full(n, -np.inf), (r["seq_id"], r["block"])
                p = np.array(r["p"]).reshape(-1, n)
                part = np.maximum(part, (r["weight"] * v[r["start"] : r["start"] + len(p), None] + p).max(axis=0))
            if r["block"] == 0 or r["start"] + len(p) == n:
                for c, value in (("seq_id", r["seq_id"]), ("block", r["block"] + 1), ("v", part)):
                    done[c].append(value)
        yield records(batch, done, v=pa.list_(pa.float64()))
