"""Mixing to target weights with soft membership.

A classifier fitted on labelled documents gives every document posteriors over domains.
Rates, the expected copies of a document, then solve a least-squares problem: the expected
tokens of each domain, summed over all documents, shall match its share of the budget, and
no rate is negative.  Projected gradient steps run over the written table of posteriors; a
step needs one sum per domain, so the driver sees as many numbers as there are domains and
each document's rate follows from the steps taken so far.  Residuals are scaled by each
domain's own curvature, which makes a few steps enough.

The classifier is a logistic regression over the words that tell the domains apart best
and a few shares of characters, words and lines.  It is fitted on at most ``LABELLED``
labelled documents, those with the smallest hash of their id; all other sums run over all
documents.  Tokens are the terms between
blanks and punctuation.  A null text has none.  Labels with a null are ignored; without usable labels, or with one
domain only, every posterior is that domain's share among the labels, or uniform.  Repeated
rows are documents of their own, with one label per id (the largest on ties); extra columns
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .columns import let, small_batches

DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.97, "poor": 0.03, "toxic": 0.0}
LABELLED = 20_000
TELLING = 500  # words the classifier knows
ROUNDS, SMOOTH = 30, 1e-3
SHARES = ("_upper", "_marks", "_digits", "_variety", "_lines", "_size")
STEPS, CLOSE = 40, 1e-4  # most steps, and the relative change of the sums that ends them
FULL = 1.02  # budget over what the documents of the heaviest domain hold, so they stay whole
MARKS = "[#*$%&|<>!]"


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 1, 0).otherwise(1)


def _described(docs: DataFrame, text: str) -> DataFrame:
    """Word terms and a few shares by which the classifier judges."""
    plain = F.coalesce(F.col(text), F.lit(""))
    size = F.greatest(F.length(plain), F.lit(1))
    terms = F.array_remove(F.split(F.lower(plain), r"[\s\p{Punct}]+"), "")

    def share(pattern):
        return F.regexp_count(plain, F.lit(pattern)) / size

    def distinct(values):
        return F.size(F.array_distinct(values)) / F.greatest(F.size(values), F.lit(1))

    described = docs.withColumns({"_terms": terms, "_upper": share("[A-Z]"), "_marks": share(MARKS), "_digits": share("[0-9]")})
    return described.withColumns(
        {
            "_variety": let(F.col("_terms"), distinct),
            "_lines": let(F.split(plain, "\n"), distinct),
            "_size": F.log1p(F.size("_terms")),
        }
    )


def _telling_words(rows: DataFrame, sizes: dict[int, int], most: int) -> list[str]:
    """The words whose share of documents differs most between a domain and the others."""
    n = sum(sizes.values())
    seen = rows.select("_domain", F.explode(F.array_distinct("_terms")).alias("word"))
    per = seen.groupBy("word").agg(*[F.sum((F.col("_domain") == d).cast("int")).alias(f"c{d}") for d in sizes])
    every = sum(F.col(f"c{d}") for d in sizes)
    z = [
        F.abs(F.col(f"c{d}") / k - (every - F.col(f"c{d}")) / (n - k)) / F.sqrt(every / n * (1 - every / n) * (1 / k + 1 / (n - k)) + 1e-12)
        for d, k in sizes.items()
    ]
    ranked = per.where(every >= 3).select("word", (F.greatest(*z) if len(z) > 1 else z[0]).alias("z"))
    return [r["word"] for r in ranked.orderBy(F.desc("z"), "word").limit(most).collect()]  # bounded


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", labelled: int = LABELLED):
    """A function from documents to documents with columns ``tokens`` and ``posteriors``."""
    docs = docs.select(F.col(key).alias("_key"), text)
    usable = labels.select(F.col(key).alias("_id"), domain_of(F.col("quality"), F.col("toxic")).alias("_domain"), "quality", "toxic")
    usable = usable.where("_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    one = usable.groupBy("_id").agg(F.max("_domain").alias("_domain"))
    sample = cut(one.orderBy(F.xxhash64("_id"), "_id").limit(labelled))
    train = docs.join(F.broadcast(sample), F.col("_key") == F.col("_id"))  # a bounded sample
    rows = cut(_described(train.select(text, "_domain"), text).drop(text))
    sizes = {r["_domain"]: r["count"] for r in rows.groupBy("_domain").count().orderBy("_domain").collect()}
    if len(sizes) < 2:
        flat = [1.0 if d in sizes else 0.0 for d in range(len(DOMAINS))] if sizes else [1.0 / len(DOMAINS)] * len(DOMAINS)
        tokens = F.size("_terms").cast("long").alias("tokens")
        return lambda df: _described(df, text).select(*df.columns, tokens, F.array(*[F.lit(p) for p in flat]).alias("posteriors"))
    known = _telling_words(rows, sizes, TELLING) or ["the"]
    counted = CountVectorizerModel.from_vocabulary(known, inputCol="_terms", outputCol="_words")
    counted.setBinary(True)
    assembled = VectorAssembler(inputCols=["_words", *SHARES], outputCol="_features")
    rows = assembled.transform(counted.transform(rows)).select("_features", "_domain")
    model = LogisticRegression(
        featuresCol="_features", labelCol="_domain", probabilityCol="_p", family="multinomial", maxIter=ROUNDS, regParam=SMOOTH
    ).fit(rows)
    classes = model.numClasses

    def score(df: DataFrame) -> DataFrame:
        done = model.transform(assembled.transform(counted.transform(_described(df, text))))
        given = vector_to_array("_p")
        full = F.concat(given, F.array_repeat(F.lit(0.0), len(DOMAINS) - classes)) if classes < len(DOMAINS) else given
        tokens = F.size("_terms").cast("long").alias("tokens")
        return done.withColumn("posteriors", full).select(*df.columns, tokens, "posteriors")

    return score


def rates_after(posteriors: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates of documents after the given steps, each a pull per domain, from one."""
    rate = np.ones(len(posteriors))
    for pull in steps:
        rate = np.maximum(0.0, rate - posteriors @ pull)
    return rate


def _posterior_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["posteriors"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(steps: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(DOMAINS))
        for batch in batches:
            if batch.num_rows:
                p = _posterior_matrix(batch)
                total += (rates_after(p, steps) * batch["tokens"].to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["domain", "total"])

    return add


def _totals(scored: DataFrame, steps: np.ndarray) -> np.ndarray:
    """Expected tokens of each domain after the given steps."""
    parts = scored.select("tokens", "posteriors").mapInArrow(_sums(steps), "domain int, total double")
    rows = parts.groupBy("domain").agg(F.sum("total").alias("total")).collect()  # a row per domain
    out = np.zeros(len(DOMAINS))
    for r in rows:
        out[r["domain"]] = r["total"]
    return out


def solve(scored: DataFrame, weights=WEIGHTS, budget: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The steps that lead to the rates, and the domains' targets.

    ``scored`` holds ``tokens`` and ``posteriors``.  Without a budget the domain of the
    largest weight keeps what its documents hold.
    """
    k = len(DOMAINS)
    p = [F.element_at("posteriors", i + 1) for i in range(k)]
    sums = [F.sum(F.col("tokens") * p[i] * p[j]) for i in range(k) for j in range(k)]
    curve = np.array([x or 0.0 for x in scored.agg(*sums).first()]).reshape(k, k)
    scale = np.where(np.diag(curve) > 0, np.diag(curve), np.inf)
    share = np.array([weights[d] for d in DOMAINS])
    share = share / share.sum()
    steps = np.empty((0, k))
    held = _totals(scored, steps)
    lead = int(share.argmax())
    whole = budget if budget is not None else FULL * held[lead] / share[lead]
    target = share * whole
    root = 1 / np.sqrt(scale)
    widest = np.linalg.eigvalsh(root[:, None] * curve * root).max(initial=0.0)
    if not widest > 0:
        return steps, target
    while len(steps) < STEPS:
        steps = np.vstack([steps, (held - target) / scale / widest])
        now = _totals(scored, steps)
        change, held = np.abs(now - held).max(), now
        if change <= CLOSE * max(whole, 1.0):
            break
    return steps, target


def _prepared(docs, labels, weights, budget, text, key, labelled):
    """The scoring function, the written narrow table of its results and the steps solved on it."""
    small_batches(docs.sparkSession)
    score = fit(docs, labels, text, key, labelled)
    scored = cut(score(docs.select(F.col(key).alias("_key"), text)).select("_key", "tokens", "posteriors"))
    return score, scored, solve(scored, weights, budget)[0]


def _copies(rated: DataFrame, key: str) -> DataFrame:
    luck = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", F.floor(F.col("rate") + luck).cast("int"))


def _rate(steps: np.ndarray):
    @F.pandas_udf(T.DoubleType())
    def rate(posteriors: pd.Series) -> pd.Series:
        p = np.array([*posteriors], float).reshape(len(posteriors), len(DOMAINS))
        return pd.Series(rates_after(p, steps))

    return rate


def rates(docs: DataFrame, labels: DataFrame, weights=WEIGHTS, budget: float | None = None, text: str = "text", key: str = "doc_id", labelled: int = LABELLED) -> DataFrame:
    """``key, tokens, posteriors, rate, copies`` of every document.

    Copies round a rate up or down by a hash of the id, so they match it on average.
    """
    _, scored, steps = _prepared(docs, labels, weights, budget, text, key, labelled)
    return _copies(scored.withColumn("rate", _rate(steps)("posteriors")), "_key").withColumnRenamed("_key", key)


def mix(docs: DataFrame, labels: DataFrame, weights=WEIGHTS, budget: float | None = None, text: str = "text", key: str = "doc_id", labelled: int = LABELLED) -> DataFrame:
    """``docs`` with every row repeated as its rate says; rows of rate zero go.

    Texts are scored once more instead of being shuffled to their rates.
    """
    score, _, steps = _prepared(docs, labels, weights, budget, text, key, labelled)
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    rated = _copies(score(renamed.withColumn(text, F.col(names[text]))).withColumn("rate", _rate(steps)("posteriors")), names[key])
    repeated = rated.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(n).alias(c) for c, n in names.items()])
