"""Line dedup: lines found in many documents leave all of them, or all but the first.

A line's key is the line without blanks at both ends and with A-Z lower-cased.  Two Bloom
filters say which keys may repeat.  Their hash space is cut into segments, as many as the
lines need, so the filters grow with the table and no task holds more than one segment.
Tasks over the texts send what they saw of each segment, four bytes a distinct line; a
segment's task puts every hash into the filter of hashes seen once, and those it finds there
already into the filter of hashes seen twice.  Only the second filters travel back, as one
broadcast of at most ``SENT`` bits: beyond that they are folded, so more lines are suspected
but none is missed.  Lines that the filter suspects are shuffled, by their whole key and
counted before the exchange; the key decides exactly, so false suspicions cost time only.

A null text is one empty line.  Every row is a document, rows with one id or a null id too.
Of rows that repeat both id and text, each keeps the first line alike.  Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .columns import small_batches

KEYS = 1 << 19  # lines of a segment of the hash space, on average
ONCE = 1 << 23  # bits of a segment's filter of hashes seen once
TWICE = 1 << 20  # bits of a segment's filter of hashes seen twice
SENT = 1 << 29  # bits of all second filters together, at most
PROBES = 4  # bits of a hash
CHUNK = 1 << 18  # hashes a task gathers before it sends them
SALTS = 16  # parts of a key's lines in the join with the repeated keys
SUSPECTS = "array<struct<line:int, key:binary, leads:boolean>>"


def line_keys(text: bytes) -> list[bytes]:
    """Keys of all lines; the blanks are space and the bytes 9 to 13."""
    return [line.strip().lower() for line in text.split(b"\n")]


def long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode()) >= chars)


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def segment(h: np.ndarray, segments: int) -> np.ndarray:
    """Equal ranges of the hash space, in the order of the hashes."""
    return ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def places(low: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash in a filter of ``bits``, a power of two."""
    z = low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    step = (z >> np.uint64(12)) | np.uint64(1)
    turn = np.arange(PROBES, dtype=np.uint64)
    return (((z >> np.uint64(36))[:, None] + step[:, None] * turn) & np.uint64(bits - 1)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]


def seen_by_segment(segments: int, min_chars: int):
    """Rows ``segment, seen, again``: distinct hashes of a chunk, and those of two documents in it."""

    def chunk(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        numbers, starts = np.unique(segment(h, segments), return_index=True)
        ends = np.append(starts[1:], len(h))
        low = h.astype("<u4")
        parts = [slice(a, b) for a, b in zip(starts, ends)]
        columns = [[low[p].tobytes() for p in parts], [low[p][n[p] > 1].tobytes() for p in parts]]
        arrays = [pa.array(numbers, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]]
        return pa.RecordBatch.from_arrays(arrays, names=["segment", "seen", "again"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for text in _texts(batch):
                own = {k for k in line_keys(text) if long_enough(k, min_chars)}
                held.append(hashes(list(own)))
                n += len(own)
                if n >= CHUNK:
                    yield chunk(held)
                    held, n = [], 0
        if n:
            yield chunk(held)

    return send


def repeats_of_segment(width: int):
    """One segment's chunks through both filters; the bits of the second one."""

    def build(key: tuple, chunks: pa.Table) -> pa.Table:
        once, twice = np.zeros(ONCE, bool), np.zeros(width, bool)
        for seen, again in zip(chunks["seen"], chunks["again"]):
            low = np.frombuffer(seen.as_buffer(), "<u4")
            at = places(low, ONCE)
            known = once[at].all(axis=1)
            once[at] = True
            for repeated in (low[known], np.frombuffer(again.as_buffer(), "<u4")):
                twice[places(repeated, width)] = True
        bits = np.packbits(twice, bitorder="little").tobytes()
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})

    return build


def second_filter(texts: DataFrame, min_chars: int) -> np.ndarray:
    """A row of bytes per segment: the filter of hashes seen in two documents."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n = texts.agg(F.sum(lines)).first()[0] or 0
    segments = max(1, -(-n // KEYS))
    width = max(64, min(TWICE, 1 << ((SENT // segments).bit_length() - 1 if segments <= SENT else 0)))
    chunks = texts.mapInArrow(seen_by_segment(segments, min_chars), "segment int, seen binary, again binary")
    rows = chunks.groupBy("segment").applyInArrow(repeats_of_segment(width), "segment int, bits binary").toArrow()
    filters = np.zeros((segments, width // 8), np.uint8)
    for number, bits in zip(rows["segment"].to_pylist(), rows["bits"]):
        filters[number] = np.frombuffer(bits.as_buffer(), np.uint8)
    return filters


def suspected(filters, min_chars: int):
    """Every document with the lines that the second filter holds; ``leads`` marks a key's first."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filters.value
        segments, width = len(bits), bits.shape[1] * 8
        for batch in batches:
            texts = _texts(batch)
            keys = [line_keys(t) for t in texts]
            flat = [k for own in keys for k in own]
            h = hashes(flat)
            at = places(h.astype("<u4"), width)
            found = (bits[segment(h, segments)[:, None], at >> 3] >> (at & 7) & 1).all(axis=1)
            starts = np.cumsum([0, *map(len, keys)])
            hits = np.array([i for i in np.flatnonzero(found).tolist() if long_enough(flat[i], min_chars)], np.int64)
            doc = np.searchsorted(starts, hits, "right") - 1
            met, leads = set(), []
            for d, i in zip(doc.tolist(), hits.tolist()):
                leads.append((d, flat[i]) not in met)
                met.add((d, flat[i]))
            rows = pa.StructArray.from_arrays(
                [pa.array(hits - starts[doc], pa.int32()), pa.array([flat[i] for i in hits.tolist()], pa.binary()), pa.array(leads, pa.bool_())],
                names=["line", "key", "leads"],
            )
            ends = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            own = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)).view(np.int64)
            columns = [
                batch["doc_id"], pa.array(own), pa.array(np.diff(starts)), batch["text"],
                pa.ListArray.from_arrays(pa.array(ends), rows),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "own", "n_lines", "text", "suspects"])

    return mark


@F.pandas_udf(T.StringType())
def without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    """The texts without the numbered lines."""

    def kept(text, numbers):
        gone = set(numbers.tolist())
        return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)

    return pd.Series([kept(*pair) for pair in zip(texts, dropped)], dtype=object)


def dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` of every document.

    Keys of ``min_chars`` code points or more that ``min_docs`` documents (two or more) hold
    lose all their lines; with ``keep="first"`` the line of the smallest id, first in its
    document, stays.
    """
    if keep not in ("none", "first") or min_docs < 2:
        raise ValueError("keep is none or first, and min_docs two or more")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    filters = spark.sparkContext.broadcast(second_filter(texts.select("text"), min_chars))
    schema = f"doc_id long, own long, n_lines long, text string, suspects {SUSPECTS}"
    marked = cut(texts.mapInArrow(suspected(filters, min_chars), schema))

    lines = marked.select("doc_id", "own", F.inline("suspects"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "own", "line")).alias("first")
    found = lines.groupBy("key").agg(F.count(F.when(F.col("leads"), 1)).alias("n"), first)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    repeated = cut(found.where(F.col("n") >= min_docs).select("key", "first")).select("key", "first", salts)
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "own", "line"), F.lit(SALTS)).cast("int"))
    gone = salted.join(repeated.hint("merge"), ["key", "salt"])  # one plan at every size
    if keep == "first":
        itself = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("own") == F.col("first.own"))
        gone = gone.where(~(itself & (F.col("line") == F.col("first.line"))))
    dropped = gone.groupBy("doc_id", "own").agg(F.collect_set("line").alias("dropped"))
    dropped = dropped.select(F.col("doc_id").alias("id"), F.col("own").alias("of"), "dropped")

    plain = marked.where(F.size("suspects") == 0)
    plain = plain.select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept"))
    open_ = marked.where(F.size("suspects") > 0).select("doc_id", "own", "n_lines", "text")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("of"))
    settled = open_.join(dropped.hint("merge"), same, "left")
    none = F.expr("cast(array() AS array<int>)")
    settled = settled.withColumn("dropped", F.coalesce("dropped", none))
    settled = settled.select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), without("text", "dropped").alias("kept")
    )
    return plain.unionByName(settled)
