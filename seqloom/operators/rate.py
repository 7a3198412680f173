"""Information rate of the parse and the threshold that maximises it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import LIMIT, Index, build_sweep
from .parse import encode

IR_TYPES = ("cum", "all", "fixed", "cum2", "cum3")
TIE_DIGITS = 9  # rates equal to this many digits count as a tie


def entropy(values: DataFrame, keys, value: str) -> DataFrame:
    """Shannon entropy (natural log) of the values normalised to sum 1."""
    x = F.col(value)
    total = F.sum(x)
    weighted = F.sum(F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return values.groupBy(*keys).agg((F.log(total) - weighted / total).alias("entropy"))


def information_rate(index: Index, ir_type: str = "cum", alpha: float = 1.0) -> DataFrame:
    """Rows ``step, ir, h0, h1``; ``step`` is a state, or the end of a word for ``all``."""
    if ir_type not in IR_TYPES:
        raise ValueError(f"unknown ir_type {ir_type!r}; known: {IR_TYPES}")
    if ir_type == "all":
        return _per_word(index, alpha)
    st = index.frames.drop("trn")
    size = F.col("word_end") - F.col("word")
    new = F.when(F.col("lrs") == 0, 1).otherwise(0)
    if ir_type == "cum":
        first = F.when(F.col("state") == F.col("word") + 1, 1).otherwise(0)
        df = index.running(st, sums={"n_new": new, "n_words": first})
        h0, h1 = F.log2("n_new"), F.log2("n_words") / size
        return _rates(index, df, h0, h1, alpha * h0 - h1)
    if ir_type == "cum2":
        df = index.running(st, sums={"n_new": new}, maxes={"top": F.col("lrs")})
        h0, h1 = F.log2("n_new"), (F.log2("state") + _log2_or_0("top")) / size
        return _rates(index, df, h0, h1, alpha * h0 - h1)
    if ir_type == "cum3":
        df = index.running(st, sums={"n_new": new})
        h0 = F.log2("n_new")
        h1 = F.when(F.col("lrs") == 0, h0).otherwise((h0 + _log2_or_0("lrs")) / F.greatest("lrs", F.lit(1)))
        return _rates(index, df, h0, h1, alpha * h0 - h1)
    whole = st.groupBy(*index.keys).agg(
        F.sum(new).alias("n_new"), F.max("lrs").alias("top"), F.max("state").alias("n")
    )
    df = st.join(whole, list(index.keys))
    h0, h1 = F.log2("n_new"), F.log2("n") + _log2_or_0("top")
    return _rates(index, df, h0, h1, alpha * h0 - h1 / size)


def _per_word(index: Index, alpha: float) -> DataFrame:
    words = encode(index).withColumn("x", F.col("len") + 1)
    df = index.running(
        words, "end",
        sums={
            "n_new": F.when(F.col("len") == 0, 1).otherwise(0),
            "total": F.col("x"),
            "weighted": F.col("x") * F.log("x"),
            "n_words": F.lit(1),
        },
    )
    h0 = F.log2("n_new")
    h1 = F.when(F.col("n_words") == 1, 0.0).otherwise(F.log("total") - F.col("weighted") / F.col("total"))
    return df.select(*index.keys, F.col("end").alias("step"), (alpha * h0 - h1).alias("ir"),
                     h0.alias("h0"), h1.alias("h1"))


def _rates(index: Index, df: DataFrame, h0: Column, h1: Column, ir: Column) -> DataFrame:
    return df.select(
        *index.keys, F.col("state").alias("step"),
        F.greatest(ir, F.lit(0.0)).alias("ir"), h0.alias("h0"), h1.alias("h1"),
    )


def _log2_or_0(name: str) -> Column:
    return F.log2(F.greatest(F.col(name), F.lit(1)))


def threshold_grid(start: float, stop: float, step: float) -> list[float]:
    """``start, start + step, ...`` below ``stop``."""
    n = max(0, -int(-((stop - start) / step - 1e-12) // 1))
    return [start + i * step for i in range(n)]


def _run_rates(seqs, grid, metric="cosine", method="inc", ir_type="cum", alpha=1.0, limit=LIMIT):
    """Total rates of the distinct automata of a sweep, and the grid values of each."""
    index, members = build_sweep(seqs, grid, metric, method, limit)
    rates = information_rate(index, ir_type, alpha)
    return rates.groupBy(*index.keys).agg(*[F.sum(c).alias(c) for c in ("ir", "h0", "h1")]), members


def threshold_rates(seqs: DataFrame, grid, metric="cosine", **options) -> DataFrame:
    """Total rate per sequence and threshold: ``seq_id, threshold, ir, h0, h1``.

    ``options``: ``method``, ``ir_type``, ``alpha``, ``limit``.  Thresholds
    between which no distance is crossed share one automaton and its rate.
    """
    rates, members = _run_rates(seqs, grid, metric, **options)
    rates = rates.join(members, ["seq_id", "threshold"])
    return rates.select("seq_id", F.col("member").alias("threshold"), "ir", "h0", "h1")


def find_threshold(seqs: DataFrame, grid=None, **options) -> DataFrame:
    """The threshold with the largest total rate per sequence; the lowest one wins ties."""
    grid = threshold_grid(0.0, 1.0, 0.1) if grid is None else grid
    rates, _ = _run_rates(seqs, grid, **options)  # the lowest of a run stands for it
    best = F.min(F.struct((-F.round("ir", TIE_DIGITS)).alias("cost"), "threshold", "ir"))
    return rates.groupBy("seq_id").agg(best.alias("b")).select("seq_id", "b.threshold", "b.ir")
