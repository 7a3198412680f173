"""Suffix dedup over bytes: 50-byte strings that a document with a smaller id also holds.

The strings are found by the minimizer search of :mod:`repeats`, not by prefix doubling: there
are no global ranks and no rerank rounds (README).  A string's anchor is the 20-byte gram
with the smallest hash inside it, so equal strings have equal anchors; grams that occur once
are dropped, equal neighbourhoods are settled as one, and where neighbourhoods of a gram
differ, positions are compared by the hashes of their two 25-byte halves, sorted in the task
of the gram's bucket.  A string's smallest document keeps its bytes; others lose them.

Null text is empty.  A null id is larger than all others, and rows with one id do not
remove each other's bytes.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Search, without_repeats

LENGTH, GRAM = 50, 20
HALF = LENGTH // 2
BYTES = Search(LENGTH, GRAM, words=False, within=False)


def rank_pairs(sent, prefixes, open_, which, step):
    """The ranks of both halves of the 50 bytes at every position."""
    low = sent.low[open_][which] + step
    return [prefixes[0].ranges(low, low + HALF), prefixes[1].ranges(low + HALF, low + LENGTH)]


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` of every document; ``kept`` is binary."""
    done = without_repeats(docs, BYTES, rank_pairs, text, key)
    return done.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "spans", "kept")
