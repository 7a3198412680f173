"""Packing of token pieces by minimum bin slack over a table of lengths.

Texts become token ids with a closing id; ids beyond a multiple of the sequence length form
the document's last piece and everything before it full pieces.  The plan needs only how
many pieces have each length, a table bounded by the sequence length.  It takes the longest
remaining length, fills the rest of a window by bitset subset sums over the counts that
remain, traces back how many of each length reach the sum closest to capacity, and uses
that multiset as often as the counts allow.  Pieces then find their sequence and offset
from their rank among the pieces of their length, so no sequence is ever gathered.

A null text is empty: a document of the closing id alone.  Repeated rows and null ids are
documents of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import cut
from .columns import small_batches
from .ordering import running, sliced

LENGTH = 1024  # tokens of a sequence
CLOSING = 0  # id after each document
NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=2)
def encoder(name: str):
    """Token ids of a text, as the vocabulary's tokenizer file gives them.

    The same merges in their rank form are several times faster; texts on which that
    library gives up, and those that hold an added token, go through the tokenizer file.
    """
    whole = _file(name)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    rows = (line.split() for line in open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in rows}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if not any(t in text for t in added):
            try:
                return fast.encode_ordinary(text)
            except Exception:
                pass
        return whole.encode(text, add_special_tokens=False).ids

    return ids


@lru_cache(maxsize=2)
def _file(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def cut_pieces(length: int, name: str, with_ids: bool):
    """Pieces of every document of the batches ``doc_id, text``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encode, rows, parts = encoder(name), [], []
            for at, text in enumerate(batch["text"]):
                ids = np.array([*encode(text.as_py() or ""), CLOSING], dtype="<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    rows.append((at, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                    if with_ids:
                        parts.append(piece.astype(np.int32))
            table = np.array(rows, np.int64).reshape(-1, 5)
            columns = [batch["doc_id"].take(pa.array(table[:, 0])), *[pa.array(table[:, i].copy()) for i in range(1, 5)]]
            if with_ids:
                ends = np.r_[0, np.cumsum(table[:, 2])].astype(np.int32)
                flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=[*NAMES, *["ids"] * with_ids])

    return split


def pieces(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", name: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` per piece, and its ``ids`` if asked."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = ", ".join(f"{c} long" for c in NAMES) + ", ids array<int>" * with_ids
    return rows.mapInArrow(cut_pieces(length, name, with_ids), schema)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill a window best, the longest remaining one among them."""
    longest = max(counts)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for n in sorted(counts, reverse=True):
        left = min(counts[n] - (n == longest), room // n)
        if left <= 0:
            continue
        trail.append((n, left, reach))
        step = 1
        while left > 0:  # bounded copies as blocks of 1, 2, 4, ... of them
            take = min(step, left)
            reach |= reach << (take * n) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = {longest: 1}
    for n, left, before in reversed(trail):
        copies = next(k for k in range(left + 1) if total >= k * n and before >> (total - k * n) & 1)
        if copies:
            used[n] = used.get(n, 0) + copies
            total -= copies * n
    return used


def plan(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[int, dict[int, int], int]]:
    """``(first sequence, copies of each length, sequences)`` until every piece is placed."""
    counts, out, first = {n: c for n, c in counts.items() if c}, [], 0
    while counts:
        used = fill(counts, capacity)
        times = min(counts[n] // k for n, k in used.items())
        out.append((first, used, times))
        first += times
        for n, k in used.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return out


def pack(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """The pieces of ``docs`` with their ``sequence_id`` and ``offset`` there."""
    written = cut(pieces(docs, length, **how))  # dealing out by ranges samples its input first: no second tokenizing
    cutted = sliced(written, "length", "doc_id", "start", "ids_crc32")
    counts = {r["length"]: r["count"] for r in cutted.groupBy("length").count().collect()}  # a row per length
    placed = running(cutted, ["length", "doc_id", "start", "ids_crc32"], rank=F.lit(1))
    at = _placer(counts, plan(counts, length))
    spot = at(F.col("rank"))
    return placed.withColumn("spot", spot).select(
        *[c for c in cutted.columns if c != "slice"], "spot.sequence_id", "spot.offset"
    )


def _placer(counts: dict[int, int], made):
    """Sequence and offset by the rank of a piece in the order of lengths.

    Every multiset of the plan takes the next ranks of each of its lengths.
    """
    sizes = sorted(counts)
    next_rank = dict(zip(sizes, np.cumsum([0, *[counts[n] for n in sizes]]).tolist()))
    rows = []
    for first, used, times in made:
        offset = 0
        for n, k in used.items():
            rows.append((next_rank[n], first, k, offset, n))
            next_rank[n] += k * times
            offset += k * n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    kind = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(kind)
    def place(rank: pd.Series) -> pd.DataFrame:
        r = rank.to_numpy()
        begin, first, copies, offset, n = table[np.searchsorted(table[:, 0], r, "right") - 1].T
        step = r - begin
        return pd.DataFrame({"sequence_id": first + step // copies, "offset": offset + step % copies * n})

    return place
