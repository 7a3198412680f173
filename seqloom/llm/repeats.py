"""Exact search for windows of units (words or bytes) that occur earlier in a corpus.

A window is found through its anchor: of the grams inside it, the one with the smallest
hash, leftmost on ties.  Equal windows have equal anchors at the same place, so only
anchors, a small share of all positions, are exchanged:

1. ``seeds``: documents are dealt into blocks by their id; a block sends each of its
   anchor grams once, to a bucket of the gram.
2. ``shared``: a bucket answers every block which of its grams occur elsewhere too.
   Grams that occur once are done with: no window around them repeats.
3. ``stretches``: consecutive windows with one anchor form a stretch.  A block sends each
   distinct stretch around a shared gram, with its text and first place, to the gram's
   bucket; later copies inside the block are settled at once.
4. ``contest``: a bucket compares the stretches of a gram and answers with the windows
   that have an earlier place.  The caller says how stretches of one gram are compared.
5. ``covered``: blocks mark the units under those windows.

What a block sends is reduced to distinct grams and stretches first, so a passage that a
third of all documents share reaches its bucket once per block.  Blocks and buckets have
bounded sizes and their number follows the bytes of the input.  Comparison is by texts and
two independent 64-bit hashes of them, nothing is sampled and no group is cut short.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .columns import drop_shuffles

BLOCK = 4_000_000  # bytes of text in a block of documents
CHUNK = 1 << 20  # units looked at together
LEVEL = 3  # of compression of what blocks and buckets exchange
PLACE = np.uint64((1 << 28) - 1)  # low bits of an order key: the place of a gram
NO_ID = np.iinfo(np.int64).max  # stands for a null id, which is smaller than no other

_rng = np.random.default_rng(20)
SYMBOLS = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so they can be inverted
WRAP = 1 << 64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Prefix:
    """Hashes of any ranges of a byte buffer, from running sums."""

    sums: np.ndarray
    inverse: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, which: int) -> Prefix:
        base = BASES[which]
        powers = np.full(len(buf) + 1, base, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(SYMBOLS[which][buf] * powers[:-1], out=sums[1:])
        powers[1:] = pow(base, -1, WRAP)
        powers[0] = 1
        return cls(sums, np.cumprod(powers, out=powers))

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64))


@dataclass
class Units:
    """The units of some documents in one buffer.

    ``edges`` are the byte positions of the units, with one more at the end; None where
    units are bytes.  ``first`` are the documents' first units, with one more at the end.
    """

    buf: np.ndarray
    edges: np.ndarray | None
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], words: bool) -> Units:
        if words:  # every word with one blank behind it
            lines = [b"".join([b" ".join(t.split()), b" "]) for t in texts]
            lines = [b"" if len(x) == 1 else x for x in lines]
            buf = np.frombuffer(b"".join(lines), np.uint8)
            edges = np.r_[0, np.flatnonzero(buf == 32) + 1]
            ends = np.cumsum([0, *[len(x) for x in lines]])
            return cls(buf, edges, np.searchsorted(edges, ends))
        return cls(np.frombuffer(b"".join(texts), np.uint8), None, np.cumsum([0, *[len(t) for t in texts]]))

    def symbols(self) -> np.ndarray:
        if self.edges is None:
            return SYMBOLS[0][self.buf]
        return Prefix.of(self.buf, 0).ranges(self.edges[:-1], self.edges[1:])

    def bytes_at(self, unit):
        return unit if self.edges is None else self.edges[unit]


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` symbols from each position on, by doubling."""
    whole, size, part, have = symbols, 1, None, 0
    while True:
        if k & size:
            if part is None:
                part = whole
            else:
                n = len(symbols) - have - size + 1
                part = part[:n] * np.uint64(pow(BASES[0], size, WRAP)) + whole[have : have + n]
            have += size
        if have == k:
            return mix(part)
        n = len(whole) - size
        whole = whole[:n] * np.uint64(pow(BASES[0], size, WRAP)) + whole[size : size + n]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


@dataclass
class Stretches:
    """Runs of consecutive windows with one anchor: first window, windows, gram, document."""

    start: np.ndarray
    count: np.ndarray
    gram: np.ndarray
    row: np.ndarray

    def take(self, which) -> Stretches:
        return Stretches(self.start[which], self.count[which], self.gram[which], self.row[which])


def stretches(units: Units, window: int, k: int) -> Stretches:
    symbols = units.symbols()
    owner = np.repeat(np.arange(len(units.first) - 1), np.diff(units.first))
    parts = [_chunk(symbols, owner, at, window, k) for at in range(0, max(len(symbols) - window + 1, 0), CHUNK)]
    if not parts:
        none = np.empty(0, np.int64)
        return Stretches(none, none, none.astype(np.uint64), none)
    return Stretches(*(np.concatenate(c) for c in zip(*parts)))


def _chunk(symbols, owner, at, window, k):
    near = symbols[at : at + CHUNK + window - 1]
    grams = gram_hashes(near, k)
    order = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(order, window - k + 1) & PLACE).astype(np.int64)
    n = len(anchor)
    doc = owner[at : at + n]
    whole = doc == owner[at + window - 1 : at + window - 1 + n]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])]
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, n])
    start, count = start[whole[start]], count[whole[start]]
    return start + at, count, grams[anchor[start]], doc[start]


@dataclass(frozen=True)
class Search:
    """What counts as a repeat: windows of ``window`` units, found by grams of ``gram``.

    ``within``: an earlier start in the same document counts too; otherwise only a
    document with a smaller id does.
    """

    window: int
    gram: int
    words: bool
    within: bool


def _block(table: pa.Table, search: Search):
    """Ids and units of a block's documents in a fixed order."""
    ids = np.array([NO_ID if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in table["text"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return ids[order], Units.of([texts[i] for i in order], search.words), order


def _by_bucket(keys: np.ndarray):
    """Positions of the rows of each bucket."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
        yield int(keys[a]), order[a:b]


SEEDS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("grams", pa.binary()), ("often", pa.binary())])
ANSWERS = pa.schema([("block", pa.int32()), ("grams", pa.binary())])
RANGES = pa.schema([("block", pa.int32()), ("rows", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
SENT = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int32())]
    + [(c, pa.binary()) for c in ("rows", "starts", "ends", "ids", "grams", "sizes", "texts")]
)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    """Rows of plain values and blobs; blobs travel and rest compressed."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    columns = [[zstandard.compress(x, LEVEL) for x in c] if f.type == pa.binary() else c for c, f in zip(columns, schema)]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _blobs(table: pa.Table, column: str) -> list[bytes]:
    return [zstandard.decompress(x) for x in table[column].to_pylist()]


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(_blobs(table, column)), kind)


def seeds(search: Search, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        ids, units, _ = _block(table, search)
        found = stretches(units, search.window, search.gram)
        order = np.argsort(found.gram, kind="stable")
        grams, owner = found.gram[order], ids[found.row[order]]
        start = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
        if not len(start):
            return _table([], SEEDS)
        if search.within:
            often = np.diff(np.r_[start, len(grams)]) > 1
        else:
            often = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
        grams, block = grams[start], table["block"][0].as_py()
        rows = [
            (b, block, grams[at].tobytes(), often[at].tobytes()) for b, at in _by_bucket((grams % np.uint64(buckets)).astype(np.int32))
        ]
        return _table(rows, SEEDS)

    return send


def shared(table: pa.Table) -> pa.Table:
    """For each block those of its grams that another block, or it itself twice, has."""
    grams, often = _joined(table, "grams", np.uint64), _joined(table, "often", bool)
    _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
    repeated = (count > 1) | (np.bincount(inverse, often, len(count)) > 0)
    keep, rows, at = repeated[inverse], [], 0
    for block, blob in zip(table["block"].to_pylist(), _blobs(table, "grams")):
        n = len(blob) // 8
        mine = grams[at : at + n][keep[at : at + n]]
        at += n
        if len(mine):
            rows.append((block, mine.tobytes()))
    return _table(rows, ANSWERS)


def send_stretches(search: Search, buckets: int):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _table([], SENT)
        ids, units, _ = _block(docs, search)
        known = np.sort(_joined(answers, "grams", np.uint64))
        found = stretches(units, search.window, search.gram)
        at = np.minimum(np.searchsorted(known, found.gram), len(known) - 1)
        found = found.take(known[at] == found.gram)
        low = units.bytes_at(found.start)
        high = units.bytes_at(found.start + found.count + search.window - 1)
        start = found.start - units.first[found.row]
        owner, text = ids[found.row], units.buf.tobytes()
        seen: dict[bytes, tuple] = {}
        settled, fresh, texts = [], [], []
        for i, (a, b, d, s) in enumerate(zip(low.tolist(), high.tolist(), owner.tolist(), start.tolist())):
            piece = text[a:b]
            place = (d, s) if search.within else (d, 0)
            if place > seen.setdefault(piece, place):
                settled.append(i)
            else:
                fresh.append(i)
                texts.append(piece)
        block, rows = docs["block"][0].as_py(), []

        def columns(which):
            return found.row[which].astype(np.int32), start[which], start[which] + found.count[which]

        if settled:
            rows.append((-1, block, *[c.tobytes() for c in columns(settled)], b"", b"", b"", b""))
        fresh = np.array(fresh, np.int64)
        for bucket, part in _by_bucket((found.gram[fresh] % np.uint64(buckets)).astype(np.int32)):
            which, own = fresh[part], [texts[i] for i in part.tolist()]
            sizes = np.array([len(t) for t in own], np.int32)
            blobs = [*columns(which), owner[which], found.gram[which], sizes]
            rows.append((bucket, block, *[c.tobytes() for c in blobs], b"".join(own)))
        return _table(rows, SENT)

    return send


@dataclass
class Sent:
    """The stretches of one bucket: places, windows, grams and texts."""

    block: np.ndarray
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    owner: np.ndarray
    gram: np.ndarray
    buf: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Sent:
        rows, start = _blobs(table, "rows"), _joined(table, "starts", np.int64)
        row = np.frombuffer(b"".join(rows), np.int32)
        size = _joined(table, "sizes", np.int32)
        high = np.cumsum(size, dtype=np.int64)
        block = np.repeat(np.array(table["block"].to_pylist(), np.int32), [len(b) // 4 for b in rows])
        count = _joined(table, "ends", np.int64) - start
        owner, gram = _joined(table, "ids", np.int64), _joined(table, "grams", np.uint64)
        return cls(block, row, start, count, owner, gram, _joined(table, "texts", np.uint8), high - size, high)


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, the first one leading, and where each distinct pair of the first two begins."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    return order, np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(order)]


def contest(search: Search, compare: Callable):
    """Windows of a bucket's stretches that have an earlier place.

    Equal stretches of a gram are compared as wholes.  Only where a gram has stretches of
    different texts are their windows compared one by one, with ``compare`` giving two
    hashes of each window.
    """

    def answer(table: pa.Table) -> pa.Table:
        sent = Sent.of(table)
        place = sent.start if search.within else np.zeros(len(sent.start), np.int64)
        prefixes = [Prefix.of(sent.buf, i) for i in range(2)]
        whole = [p.ranges(sent.low, sent.high) for p in prefixes]
        order, new = groups(*whole, sent.owner, place)
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        lead = order[new]  # the earliest stretch of each text
        later = (sent.owner > sent.owner[lead][kind]) | (sent.owner == sent.owner[lead][kind]) & (place > place[lead][kind])
        out = [(sent.block[later], sent.row[later], sent.start[later], sent.start[later] + sent.count[later])]

        grams = np.sort(sent.gram[lead])
        many = grams[1:][grams[1:] == grams[:-1]]  # grams of different texts
        if len(many):
            at = np.minimum(np.searchsorted(many, sent.gram[lead]), len(many) - 1)
            open_ = lead[many[at] == sent.gram[lead]]
            out += _windows(sent, search, compare, prefixes, open_, kind, ~later)
        block, row, start, end = (np.concatenate(c) for c in zip(*out))
        rows = [
            (b, row[at].tobytes(), start[at].tobytes(), end[at].tobytes()) for b, at in _by_bucket(block.astype(np.int32))
        ]
        return _table(rows, RANGES)

    return answer


def _windows(sent: Sent, search: Search, compare, prefixes, open_, kind, leading):
    """Runs of windows of the leading stretches that an earlier place has, one by one compared."""
    count = sent.count[open_]
    which = np.repeat(np.arange(len(open_)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hashes = compare(sent, prefixes, open_, which, step)
    owner = sent.owner[open_][which]
    place = sent.start[open_][which] + step if search.within else np.zeros(len(which), np.int64)
    order, new = groups(*hashes, owner, place)
    group = np.cumsum(new) - 1
    first = order[new][group]  # in sorted order: the earliest window of the same text
    earlier = np.zeros(len(which), bool)
    earlier[order] = (owner[first] < owner[order]) | (owner[first] == owner[order]) & (place[first] < place[order])
    mark = np.flatnonzero(earlier)
    if not len(mark):
        return []
    gap = np.r_[True, (which[mark][1:] != which[mark][:-1]) | (step[mark][1:] != step[mark][:-1] + 1)]
    begin = mark[gap]
    length = np.diff(np.r_[np.flatnonzero(gap), len(mark)])
    owners = open_[which[begin]]
    # Rows that share the leading place (repeated rows, or one document's own copies) get the same runs.
    peers = np.flatnonzero(leading)
    peers = peers[np.argsort(kind[peers], kind="stable")]
    left = np.searchsorted(kind[peers], kind[owners], "left")
    many = np.searchsorted(kind[peers], kind[owners], "right") - left
    at = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    peer, start, length = peers[at], np.repeat(step[begin], many), np.repeat(length, many)
    return [(sent.block[peer], sent.row[peer], sent.start[peer] + start, sent.start[peer] + start + length)]


def remove(search: Search):
    """Units, removed spans and kept text of every document of a block."""

    def apply(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([[], [], [], [], []], schema=RESULT)
        _, units, order = _block(docs, search)
        change = np.zeros(units.first[-1] + 1, np.int64)
        if ranges.num_rows:
            base = units.first[_joined(ranges, "rows", np.int32)]
            np.add.at(change, base + _joined(ranges, "starts", np.int64), 1)
            np.add.at(change, base + _joined(ranges, "ends", np.int64) - 1 + search.window, -1)
        gone = np.cumsum(change)[:-1] > 0
        wide = gone if units.edges is None else np.repeat(gone, np.diff(units.edges))
        spans, removed, kept, sizes = [], [], [], []
        for a, b in zip(units.first[:-1].tolist(), units.first[1:].tolist()):
            low, high = int(units.bytes_at(a)), int(units.bytes_at(b))
            hole, text = gone[a:b], units.buf[low:high]
            n = int(hole.sum())
            turn = np.flatnonzero(np.diff(np.r_[False, hole, False])) if n else np.empty(0, np.int64)
            spans.append([{"start": s, "end": e} for s, e in turn.reshape(-1, 2).tolist()])
            text = (text[~wide[low:high]] if n else text).tobytes()
            kept.append(text[:-1] if search.words else text)
            removed.append(n)
            sizes.append(b - a)
        ids = docs["doc_id"].take(pa.array(order, pa.int64()))
        return pa.table([ids, sizes, removed, spans, kept], schema=RESULT)

    return apply


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64())]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
)
RESULT_DDL = "doc_id long, n_units long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def without_repeats(docs: DataFrame, search: Search, compare: Callable, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``doc_id, n_units, n_removed, spans, kept`` of every document.

    ``spans`` are the removed runs of units, ends exclusive; ``kept`` is the rest: the
    bytes, or the words joined by single blanks.
    """
    drop_shuffles(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // block))
    of_block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block")
    blocks = docs.select(of_block, F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sent_seeds = blocks.groupBy("block").applyInArrow(seeds(search, n), _ddl(SEEDS))
    answers = cut(sent_seeds.groupBy("bucket").applyInArrow(shared, _ddl(ANSWERS)))
    sent = cut(
        blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send_stretches(search, n), _ddl(SENT))
    )
    settled = sent.where("bucket < 0").select("block", "rows", "starts", "ends")
    lost = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(contest(search, compare), _ddl(RANGES))
    ranges = cut(settled.unionByName(lost))
    return blocks.groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(remove(search), RESULT_DDL)
