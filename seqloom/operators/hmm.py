"""Hidden-Markov views of the automaton: transition tensors, emissions, Viterbi scores."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources import sequences
from . import maxplus
from .automaton import LIMIT, Index
from .similarity import with_row_share

EPS = sys.float_info.epsilon


def hmm_tensor(index: Index, max_lrs: int | None = None, smooth: bool = False) -> DataFrame:
    """Label-to-label counts per order: ``layer, from, to, n, hist, prob, unseen``.

    Layer 0 counts every neighbouring pair, layer m only those whose second state
    repeats at least m + 2 items.  There are ``max_lrs`` layers, by default one less
    than the longest repeat.  With ``smooth`` every cell starts at one; cells without a
    row then have the probability ``unseen`` of their matrix row.
    """
    keys = list(index.keys)
    counted = (
        index.frames.where("state > 1")
        .groupBy(*keys, F.col("prev_label").alias("from"), F.col("label").alias("to"), "lrs")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shape = index.frames.groupBy(*keys).agg(
        F.max("lrs").alias("top"), F.sum(F.when(F.col("sfx") == 0, 1).otherwise(0)).alias("n_labels")
    )
    layers = F.col("top") - 1 if max_lrs is None else F.lit(max_lrs)
    depth = F.least(F.greatest(F.col("lrs") - 1, F.lit(1)), F.col("layers"))
    cells = (
        counted.join(shape.withColumn("layers", layers), keys)
        .where("layers > 0")
        .select("*", F.explode(F.sequence(F.lit(0), depth - 1)).alias("layer"))
        .groupBy(*keys, "layer", "from", "to", "n_labels")
        .agg(F.sum("n").alias("n"))
    )
    shared = with_row_share(cells, [*keys, "layer"])
    if not smooth:
        return shared.drop("n_labels").withColumn("unseen", F.lit(0.0))
    total = F.col("hist") + F.col("n_labels")
    return (
        shared.withColumn("prob", (F.col("n") + 1) / total)
        .withColumn("unseen", 1.0 / total)
        .drop("n_labels")
    )


def cluster_medians(index: Index, seqs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per-dimension medians of every cluster: ``label, dim, med``.

    ``median`` keeps the distinct values of a group in memory; beyond ``limit`` states
    the values are ranked in slices instead and the middle ones picked.
    """
    items = sequences.number(seqs, index.longest).withColumnRenamed("pos", "state")
    labelled = index.frames.select(*index.keys, "state", "label").join(items, ["seq_id", "state"])
    values = labelled.select(*index.keys, "label", F.posexplode("item").alias("dim", "x"))
    group = [*index.keys, "label", "dim"]
    if index.longest <= limit:
        return values.groupBy(*group).agg(F.median("x").alias("med"))
    lists = values.select(F.struct(*group).alias("seq_id"), F.struct("x").alias("ord"), F.col("x").alias("item"))
    ranked = sequences.number(lists).join(sequences.lengths(lists), "seq_id")
    middle = ranked.where("pos IN ((n + 1) div 2, n div 2 + 1)")
    med = middle.groupBy("seq_id").agg(F.avg("item").alias("med"))
    return med.select("seq_id.*", "med")


def recognition(index: Index, seqs: DataFrame, obs: DataFrame, order: int = 1, smooth: bool = False, limit: int = LIMIT):
    """Viterbi scores of every observation sequence on the model with the same ``seq_id``.

    Rows ``t, label, score, back`` (t from 1): emissions are log dot products with the
    cluster medians scaled to sum 1, transitions come from the last tensor layer plus
    one, and ``back`` is the best predecessor of the next step (null at the end).
    Sequences of more than ``limit`` observations are scored in blocks (:mod:`maxplus`).
    """
    models = _models(index, seqs, order, smooth, limit)
    short, long = by_length(obs, limit)
    joined = sequences.pack(short).join(models, "seq_id").select("seq_id", "items", "n_labels", "med", "cells")
    schema = f"seq_id {obs.schema['seq_id'].dataType.simpleString()}, t int, label int, score double, back int"
    scored = sequences.spread(joined, "seq_id").mapInArrow(_viterbi, schema)
    return scored if long is None else scored.unionByName(_in_blocks(long, models))


def by_length(obs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The sequences of at most ``limit`` items, and the longer ones if there are any."""
    sized = sequences.lengths(obs)
    if (sized.agg(F.max("n")).first()[0] or 0) <= limit:
        return obs, None
    return tuple(obs.join(sized.where(c), "seq_id").drop("n") for c in (F.col("n") <= limit, F.col("n") > limit))


def _models(index: Index, seqs: DataFrame, order: int, smooth: bool, limit: int = LIMIT) -> DataFrame:
    """One row per model; its size follows the clusters, their medians and stored cells."""
    med = (
        cluster_medians(index, seqs, limit)
        .groupBy("seq_id")
        .agg(F.sort_array(F.collect_list(F.struct("label", "dim", "med"))).alias("med"))
        .select("seq_id", F.col("med.med").alias("med"))
    )
    tensor = hmm_tensor(index, order, smooth).where(F.col("layer") == order - 1)
    cells = tensor.groupBy("seq_id").agg(
        F.collect_list(F.struct("from", "to", "prob", "unseen")).alias("cells")
    )
    width = index.frames.groupBy("seq_id").agg(
        F.sum(F.when(F.col("sfx") == 0, 1).otherwise(0)).cast("int").alias("n_labels")
    )
    return width.join(med, "seq_id").join(cells, "seq_id", "left")


def emissions(n_labels: int, med, items) -> np.ndarray:
    """Log dot products of the observations with the medians scaled to sum 1."""
    means = np.array(med).reshape(n_labels, -1) + EPS
    means /= means.sum(axis=1, keepdims=True)
    return np.log(np.array(items) @ means.T)


def _in_blocks(obs: DataFrame, models: DataFrame) -> DataFrame:
    """The scores of long sequences, from the incoming scores of their blocks."""
    blocks = cut(maxplus.in_blocks(obs, models))
    size = maxplus.BLOCK

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, emit = maxplus.Transitions(r["n_labels"], r["cells"]), emissions(r["n_labels"], r["med"], r["items"])
                v = emit[0] - np.log(a.n) if r["v"] is None else a.step(np.array(r["v"])[None])[0] + emit[0]
                backs, rows = [], []
                for t in range(len(emit)):
                    rows.append(v)
                    step, back = a.best(v)
                    backs.append(back)
                    if t + 1 < len(emit):
                        v = step + emit[t + 1]
                back = np.array(backs)
                ended = np.zeros(back.shape, bool)
                ended[-1] = r["last"]
                n, labels = len(emit), np.arange(a.n, dtype=np.int32)
                columns = [
                    pa.array([r["seq_id"]] * (n * a.n), batch.schema.field("seq_id").type),
                    pa.array(np.repeat(np.arange(n, dtype=np.int32) + r["block"] * size + 1, a.n)),
                    pa.array(np.tile(labels, n)),
                    pa.array(np.array(rows).ravel()),
                    pa.array(back.ravel().astype(np.int32), mask=ended.ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["seq_id", "t", "label", "score", "back"])

    started = blocks.join(maxplus.incoming(blocks, emissions), ["seq_id", "block"])
    schema = f"seq_id {obs.schema['seq_id'].dataType.simpleString()}, t int, label int, score double, back int"
    return sequences.spread(started, "seq_id", "block").mapInArrow(score, schema)


def log_transitions(n_labels: int, cells, smooth: float = 1.0) -> np.ndarray:
    """Log of the row-normalised ``probabilities + smooth`` of one model."""
    a = np.zeros((n_labels, n_labels))
    for c in cells or []:
        row = a[c["from"]]
        row[row == 0] = c["unseen"]
        row[c["to"]] = c["prob"]
    a += EPS + smooth
    return np.log(a / a.sum(axis=1, keepdims=True))


CELLS = 1 << 18  # scores of a batch


def _viterbi(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scores of packed sequences, so many observations at a time that a batch stays small."""
    for batch in batches:
        for at in range(len(batch)):
            r = batch.slice(at, 1).to_pylist()[0]
            n, log_a, obs = r["n_labels"], log_transitions(r["n_labels"], r["cells"]), r["items"]
            size, v = max(1, CELLS // n), None
            for start in range(0, len(obs), size):
                emit = emissions(n, r["med"], obs[start : start + size])
                rows, backs = [], []
                for t, e in enumerate(emit, start + 1):
                    v = e - np.log(n) if v is None else step + e
                    rows.append(v)
                    moves = v[:, None] + log_a
                    step = moves.max(axis=0)
                    backs.append(moves.argmax(axis=0))
                back = np.array(backs, dtype=np.int32)
                ended = np.zeros(back.shape, bool)
                ended[-1] = t == len(obs)
                columns = [
                    pa.array([r["seq_id"]] * back.size, batch.schema.field("seq_id").type),
                    pa.array(np.repeat(np.arange(start + 1, t + 1, dtype=np.int32), n)),
                    pa.array(np.tile(np.arange(n, dtype=np.int32), len(back))),
                    pa.array(np.array(rows).ravel()),
                    pa.array(back.ravel(), mask=ended.ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["seq_id", "t", "label", "score", "back"])
