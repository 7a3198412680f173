"""Substring dedup over words: windows of 20 words that occur earlier in the corpus.

The windows are found by the minimizer search of :mod:`repeats`, not by de Bruijn compaction:
there is no edge table, branching test or compaction of paths (README).  Consecutive windows
of a document with one anchor gram of 8 words travel as one row with their text and source
coordinates (document and first word).  Grams that occur once are dropped, equal rows are
settled as one, and only where rows of one gram differ are their windows compared one by one,
by two hashes.  Of every window the smallest source coordinate survives; the words under all
other occurrences are removed.

Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte.  A null text has none.  A null id is
larger than all others.  Rows that repeat an id share their coordinates: equal texts under
one id do not remove each other.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Search, without_repeats

WINDOW, GRAM = 20, 8
WORDS = Search(WINDOW, GRAM, words=True, within=True)


def edge_hashes(sent, prefixes, open_, which, step):
    """Two hashes of each edge of the opened paths."""
    blanks = np.flatnonzero(sent.buf == 32)  # one behind every word
    first = np.searchsorted(blanks, sent.low[open_])[which] + step
    low = np.where(step == 0, sent.low[open_][which], blanks[np.maximum(first - 1, 0)] + 1)
    high = blanks[first + WINDOW - 1] + 1
    return [p.ranges(low, high) for p in prefixes]


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` of every document."""
    done = without_repeats(docs, WORDS, edge_hashes, text, key)
    return done.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "spans", F.col("kept").cast("string").alias("kept"))
