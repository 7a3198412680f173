"""Next-symbol prediction from contexts, acceptance and log-loss."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import sequences
from .automaton import LIMIT, build_index
from .context_joins import accept_by_joins, predict_by_joins
from .links import link_symbols

CHUNK = 1000  # contexts that share one rebuilt model inside a task



def answer_type(symbol: T.DataType) -> T.ArrayType:
    fields = [
        ("ctx_id", T.LongType()), ("accepted", T.BooleanType()), ("state", T.IntegerType()), ("used", T.IntegerType()),
        ("symbols", T.ArrayType(symbol)), ("probs", T.ArrayType(T.DoubleType())),
    ]
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


class Model:
    """Links of one symbol sequence; symbols below a state are those of a stretch of a tour.

    ``tour`` walks the tree of reverse suffix links, so the states below a state stand
    together.  ``codes`` are the symbols of their forward links in that order, and
    ``places`` where each symbol stands in it: a count below a state is the distance of two
    places, and memory follows the links, whatever the alphabet.
    """

    def __init__(self, items):
        links = link_symbols(items)
        self.symbols = list(dict.fromkeys(items))
        self.code = {c: j for j, c in enumerate(self.symbols)}
        label, self.lrs, sfx = links["label"], links["lrs"], links["sfx"]
        self.goto = [{label[t]: t for t in targets} for targets in links["trn"]]
        self.children: list[list[int]] = [[] for _ in sfx]
        for s in range(1, len(sfx)):
            self.children[sfx[s]].append(s)
        size = np.ones(len(sfx), np.int64)
        for s in range(len(sfx) - 1, 0, -1):
            size[sfx[s]] += size[s]
        enter = np.zeros(len(sfx), np.int64)
        free = enter + 1  # where the next child of a state enters
        for s in range(1, len(sfx)):
            enter[s] = free[sfx[s]]
            free[sfx[s]] += size[s]
            free[s] = enter[s] + 1
        degree = np.array([len(step) for step in self.goto])
        tour = np.argsort(enter)
        ends = np.r_[0, np.cumsum(degree[tour])]
        self.first, self.last = ends[enter], ends[enter + size]
        self.codes = np.array([c for s in tour for c in self.goto[s]], np.int64)
        order = np.argsort(self.codes, kind="stable")
        self.places = np.split(order, np.searchsorted(self.codes[order], np.arange(1, len(self.symbols))))

    def accept(self, context) -> tuple[bool, int]:
        """Whether forward links spell the context, and the last state reached."""
        state = 0
        for c in context:
            nxt = self.goto[state].get(self.code.get(c))
            if nxt is None:
                return False, state
            state = nxt
        return True, state

    def matched(self, context) -> tuple[int, list[int], int]:
        """The state reached, the states like it, and how much of the context's end was used."""
        context = list(context)
        ok, state = self.accept(context)
        while not ok:
            context = context[1:]
            ok, state = self.accept(context)
        similar = self._similar(state, len(context))
        while not similar:
            context = context[1:]
            _, state = self.accept(context)
            similar = self._similar(state, len(context))
        return state, similar, len(context)

    def predict(self, context) -> tuple[np.ndarray, int]:
        """Symbol counts, one added to each, and how much of the context's end was used."""
        state, similar, used = self.matched(context)
        counts = np.ones(len(self.symbols))
        counts[list(self.goto[state])] += 1.0
        for s in similar:
            counts += np.bincount(self.codes[self.first[s] : self.last[s]], minlength=len(counts))
        return counts, used

    def share(self, context, symbol) -> tuple[float, int]:
        """The probability of one symbol, without those of the others, and the used length."""
        state, similar, used = self.matched(context)
        total = len(self.symbols) + len(self.goto[state]) + sum(int(self.last[s] - self.first[s]) for s in similar)
        code, count = self.code.get(symbol), 1
        if code is not None:
            at = self.places[code]
            count += (code in self.goto[state]) + sum(
                int(np.searchsorted(at, self.last[s]) - np.searchsorted(at, self.first[s])) for s in similar
            )
        return count / total, used

    def _similar(self, state, size):
        return [s for s in self.children[state] if self.lrs[s] >= size]

    def log_loss(self, test, m_order=None) -> tuple[float, float]:
        """Mean code length in bits and mean context length over a test sequence.

        A symbol the model never saw has the share of one that was never counted.
        """
        bits, lengths, context = 0.0, 0.0, []
        for symbol in test:
            prob, used = self.share(context, symbol)
            if used < len(context):
                context = context[-used:]  # an unused context is kept whole
            bits -= math.log2(prob)
            context = [*context, symbol]
            if m_order is not None:
                context = context[-m_order:]
            lengths += len(context)
        return bits / len(test), lengths / len(test)


def _answers(symbol: T.DataType):
    """Answers on contexts for symbols of any type."""
    shape = to_arrow_type(answer_type(symbol))

    @F.arrow_udf(answer_type(symbol))
    def answers(items: pa.Array, asked: pa.Array) -> pa.Array:
        out = []
        for seq, questions in zip(items.to_pylist(), asked.to_pylist()):
            model, rows = Model(seq), []
            for q in questions:
                accepted, state = model.accept(q["context"])
                counts, used = model.predict(q["context"])
                rows.append(
                    {
                        "ctx_id": q["ctx_id"], "accepted": accepted, "state": state, "used": used,
                        "symbols": model.symbols, "probs": (counts / counts.sum()).tolist(),
                    }
                )
            out.append(rows)
        return pa.array(out, type=shape)

    return answers


def _asked(seqs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Models joined with chunks of their contexts (``seq_id, ctx_id, context``)."""
    chunks = contexts.groupBy("seq_id", F.expr(f"ctx_id div {CHUNK}").alias("chunk")).agg(
        F.collect_list(F.struct("ctx_id", "context")).alias("asked")
    )
    joined = sequences.spread(chunks.join(sequences.pack(seqs), "seq_id"), "seq_id", "chunk")
    return joined.select("seq_id", F.inline(_answers(seqs.schema["item"].dataType)("items", "asked")))


def _longest(seqs: DataFrame) -> int:
    return sequences.lengths(seqs).agg(F.max("n")).first()[0] or 0


def accept(seqs: DataFrame, contexts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Whether each context is spelled by forward links: ``ctx_id, accepted, state``."""
    if _longest(seqs) > limit:
        return accept_by_joins(build_index(seqs), seqs, contexts)
    return _asked(seqs, contexts).select("seq_id", "ctx_id", "accepted", "state")


def predict(seqs: DataFrame, contexts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Next-symbol probabilities: ``ctx_id, used, symbol, prob``; ``ctx_id`` is dense."""
    if _longest(seqs) > limit:
        return predict_by_joins(build_index(seqs), seqs, contexts)
    probs = F.arrays_zip("symbols", "probs")
    return _asked(seqs, contexts).select(
        "seq_id", "ctx_id", "used", F.inline(probs).alias("symbol", "prob")
    )


_LOSS = T.StructType([T.StructField("log_loss", T.DoubleType()), T.StructField("mean_context", T.DoubleType())])


def log_loss(seqs: DataFrame, tests: DataFrame, m_order: int | None = None) -> DataFrame:
    """``log_loss, mean_context`` of every test sequence under the model of its ``seq_id``.

    ``tests`` is a sequence frame with an extra ``test_id``.
    """

    @F.arrow_udf(_LOSS)
    def loss(items: pa.Array, test: pa.Array) -> pa.Array:
        rows = [Model(a).log_loss(b, m_order) for a, b in zip(items.to_pylist(), test.to_pylist())]
        cols = [pa.array([r[c] for r in rows], pa.float64()) for c in range(2)]
        return pa.StructArray.from_arrays(cols, names=["log_loss", "mean_context"])

    packed = sequences.pack(tests, "test_id").withColumnRenamed("items", "test")
    longest = _longest(seqs)
    if longest > LIMIT:
        raise ValueError(f"log-loss holds one model per task; {longest} > {LIMIT} items")
    models = sequences.pack(seqs)
    scored = sequences.spread(models.join(packed, "seq_id"), "seq_id", "test_id").select("seq_id", "test_id", loss("items", "test").alias("l"))
    return scored.select("seq_id", "test_id", "l.log_loss", "l.mean_context")
