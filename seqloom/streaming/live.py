"""Structured Streaming operators: live tracking and automata that grow with the stream.

Both keep their state per stream key in the state store.  By default rows of one key must
arrive in order across micro-batches; inside a micro-batch they are sorted by the order columns.

With ``event_time``, a timestamp column under the stream's watermark, rows wait in the state
store until the watermark has passed them: a timer per waiting millisecond then releases what is
due, in order of event time and the order columns.  What comes later than the watermark allows is
dropped before it changes anything, and :func:`late_rows` counts it.  So a key's rows give what one
batch of those that were on time gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.links import add_state
from ..operators.tracker import MODEL, Follower

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_CELL = T.StructType(
    [
        T.StructField("from", T.IntegerType()),
        T.StructField("to", T.IntegerType()),
        T.StructField("prob", T.DoubleType()),
        T.StructField("unseen", T.DoubleType()),
    ]
)
_MODEL = T.StructType(
    [
        T.StructField("n_labels", T.IntegerType()),
        T.StructField("med", T.ArrayType(T.DoubleType())),
        T.StructField("cells", T.ArrayType(_CELL)),
        T.StructField("label", T.ArrayType(T.IntegerType())),
    ]
)
_SCORES = T.StructType(
    [
        T.StructField("v", T.ArrayType(T.DoubleType())),
        T.StructField("frame", T.IntegerType()),
        T.StructField("t", T.LongType()),
    ]
)
TRACKED = T.StructType(
    [
        T.StructField("seq_id", T.LongType()),
        T.StructField("t", T.LongType()),
        T.StructField("frame", T.IntegerType()),
    ]
)


class InOrder(StatefulProcessor):
    """Hands rows to ``take`` in order: at once, or when the watermark has passed them.

    State: waiting rows by the millisecond of their event time.
    """

    def __init__(self, order: str | list[str], item: T.DataType, timed: bool):
        self.order, self.item, self.timed = [order] if isinstance(order, str) else list(order), item, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.timed:
            long_lists = T.ArrayType(T.ArrayType(T.LongType()))
            rows = [T.StructField("at", long_lists), T.StructField("item", T.ArrayType(self.item)), T.StructField("reset", T.ArrayType(T.BooleanType()))]
            self.waiting = handle.getMapState("waiting", T.StructType([T.StructField(DUE, T.LongType())]), T.StructType(rows))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.timed:
            yield self.take(key, pd.concat(list(rows)).sort_values(self.order, kind="stable"))
            return
        for batch in (b for b in rows if len(b)):
            for due, part in batch.groupby(batch[DUE]):
                at = [[int(v) for v in row] for row in part[[MICROS, *self.order]].to_numpy()]
                item = [x if isinstance(x, str) or x is None else [float(v) for v in x] for x in part["item"]]
                reset = [bool(v) for v in part.get("reset", [False] * len(part))]
                slot = (int(due),)
                if self.waiting.containsKey(slot):
                    at, item, reset = (list(a) + b for a, b in zip(self.waiting.getValue(slot), (at, item, reset)))
                else:
                    self.handle.registerTimer(int(due))
                self.waiting.updateValue(slot, ([list(map(int, a)) for a in at], item, reset))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = sorted(k[0] for k in self.waiting.keys() if k[0] <= expiredTimerInfo.getExpiryTimeInMs())
        rows = []
        for slot in due:
            rows += zip(*self.waiting.getValue((slot,)))
            self.waiting.removeKey((slot,))
        if rows:
            rows.sort(key=lambda r: list(r[0]))
            yield self.take(key, pd.DataFrame(rows, columns=["at", "item", "reset"]))

    def close(self) -> None:
        pass


DUE, MICROS = "due_ms", "due_us"  # columns of the event time


def in_order(stream: DataFrame, event_time: str | None) -> DataFrame:
    """The stream with its event time as whole numbers, if it is to wait for its watermark."""
    if event_time is None:
        return stream
    return stream.withColumn(DUE, F.unix_millis(event_time)).withColumn(MICROS, F.unix_micros(event_time))


def late_rows(query) -> int:
    """Rows of a query that came after the watermark and were dropped, as its progress reports tell."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])


class _Track(InOrder):
    """State: the key's model (set once from the fitted models) and the running scores."""

    def __init__(self, order: str | list[str], timed: bool, decay: float, rule: str):
        super().__init__(order, T.ArrayType(T.DoubleType()), timed)
        self.decay, self.rule = decay, rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.model = handle.getValueState("model", _MODEL)
        self.scores = handle.getValueState("scores", _SCORES)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        cells = [tuple(c[f] for f in ("from", "to", "prob", "unseen")) for c in row["cells"]]
        self.model.update(
            (int(row["n_labels"]), [float(x) for x in row["med"]], cells, [int(x) for x in row["label"]])
        )

    def take(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        if not self.model.exists():
            raise ValueError(f"no model for stream {key[0]!r}")
        n_labels, med, cells, label = self.model.get()
        cells = [dict(zip(("from", "to", "prob", "unseen"), c)) for c in cells]
        v, frame, t = self.scores.get() if self.scores.exists() else (None, 0, 0)
        follower = Follower(n_labels, med, cells, label, self.decay, self.rule, v, frame)
        frames = []
        for item, anew in zip(batch["item"], batch.get("reset", [False] * len(batch))):
            if anew:
                follower = Follower(n_labels, med, cells, label, self.decay, self.rule, None, 0)
            frames.append(follower.observe(item))
        self.scores.update(([float(s) for s in follower.v], follower.frame, t + len(frames)))
        steps = range(t + 1, t + len(frames) + 1)
        return pd.DataFrame({"seq_id": key[0], "t": list(steps), "frame": frames})


def track_stream(
    stream: DataFrame, models: DataFrame, order: str | list[str] = "pos", decay: float = 1.0, rule: str = "predicted",
    event_time: str | None = None,
) -> DataFrame:
    """Follow streams ``seq_id, <order>, item`` on fitted models: rows ``seq_id, t, frame``.

    ``order`` is one column or a list of them; with ``event_time`` they are whole numbers.  A true value in an optional boolean column
    ``reset`` starts the scores of its stream anew with that row.

    The models enter the state store as initial state, so no task holds all of them and
    a restart finds them with the scores.
    """
    return in_order(stream, event_time).groupBy("seq_id").transformWithStateInPandas(
        _Track(order, event_time is not None, decay, rule), TRACKED, "append", _mode(event_time),
        initialState=models.select("seq_id", *MODEL).groupBy("seq_id"),
    )


def _mode(event_time: str | None) -> str:
    return "none" if event_time is None else "eventTime"


def ints(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType()) for n in names])


STATE_ROWS = T.StructType([T.StructField("seq_id", T.LongType()), *ints("state", "sfx", "lrs", "label")])


class Cells:
    """A map state read through a cache and written back once per micro-batch; a ``new`` key has none to read."""

    def __init__(self, state, pack=lambda v: (v,), unpack=lambda v: v[0], new: bool = False):
        self.state, self.pack, self.unpack, self.new = state, pack, unpack, new
        self.seen: dict = {}
        self.changed: set = set()

    @staticmethod
    def _key(key):
        return key if isinstance(key, tuple) else (key,)

    def get(self, key):
        if key not in self.seen:
            found = not self.new and self.state.containsKey(self._key(key))
            self.seen[key] = self.unpack(self.state.getValue(self._key(key))) if found else None
        return self.seen[key]

    def __getitem__(self, key):
        return self.get(key)

    def __setitem__(self, key, value):
        self.seen[key] = value
        self.changed.add(key)

    def flush(self):
        for key in self.changed:
            self.state.updateValue(self._key(key), self.pack(self.seen[key]))


SPAN = 32  # consecutive numbers of each part of a key that one map entry holds


class Buckets(Cells):
    """Cells of whole numbers, neighbours together in one entry of the map state."""

    def _bucket(self, key) -> tuple:
        at = tuple(int(k) // SPAN for k in self._key(key))
        if at not in self.seen:
            found = not self.new and self.state.containsKey(at)
            held = self.state.getValue(at) if found else ([], [])
            self.seen[at] = {tuple(k): v for k, v in zip(*held)}
        return at

    def get(self, key):
        return self.seen[self._bucket(key)].get(self._key(key))

    def __setitem__(self, key, value):
        at = self._bucket(key)
        self.seen[at][tuple(int(k) for k in self._key(key))] = value
        self.changed.add(at)

    def flush(self):
        for at in self.changed:
            self.state.updateValue(at, ([list(k) for k in self.seen[at]], [self.pack(v) for v in self.seen[at].values()]))


def bucket_map(handle: StatefulProcessorHandle, name: str, key: T.StructType, value: T.DataType = T.IntegerType()):
    """The map state of :class:`Buckets`."""
    held = [T.StructField("k", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("v", T.ArrayType(value))]
    return handle.getMapState(name, T.StructType([T.StructField(f, T.LongType()) for f in key.names]), T.StructType(held))


def link_maps(handle: StatefulProcessorHandle) -> dict:
    """Map states of an automaton's links, whatever its items are."""
    keys = {"sfx": ("state",), "lrs": ("state",), "label": ("state",), "twin": ("sfx", "lrs", "label")}
    return {name: bucket_map(handle, name, ints(*key)) for name, key in keys.items()}


class _Grow(InOrder):
    """State: links and counters of the key's automaton, in map entries of neighbouring states or links.

    A step touches the suffix chain of the last state only, so the automaton may be far
    larger than a task's memory.
    """

    def __init__(self, order: str | list[str], timed: bool):
        super().__init__(order, T.StringType(), timed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.size = handle.getValueState("size", ints("n", "fresh"))
        self.maps = {**link_maps(handle), "goto": bucket_map(handle, "goto", ints("state", "label"))}
        self.codes = handle.getMapState("code", T.StructType([T.StructField("s", T.StringType())]), ints("v"))

    def take(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        n, fresh = self.size.get() if self.size.exists() else (0, 0)
        cells = {name: Buckets(state, int, new=n == 0) for name, state in self.maps.items()}
        cells["code"] = Cells(self.codes, new=n == 0)
        sfx, lrs, label, twin, goto, code = cells.values()
        if n == 0:
            sfx[0], lrs[0] = -1, 0

        def hit(k, i):
            t = goto.get((k, label[i]))
            return None if t is None else (0.0, t)

        def link(k, i):
            goto[(k, label[i])] = i

        out = []
        for symbol in batch["item"]:
            n += 1
            known = code.get(symbol)
            if known is None:
                code[symbol] = known = fresh
            label[n] = known
            if add_state(n, fresh, label, sfx, lrs, twin, hit, link):
                fresh += 1
            out.append((key[0], n, sfx[n], lrs[n], label[n]))
        for c in cells.values():
            c.flush()
        self.size.update((n, fresh))
        return pd.DataFrame(out, columns=STATE_ROWS.names)


def grow_stream(stream: DataFrame, order: str | list[str] = "pos", event_time: str | None = None) -> DataFrame:
    """Index symbol streams ``seq_id, <order>, item`` as they arrive: one row per new state.

    ``order`` is one column or a list of them; name as many as make the order of a key's
    rows unique.  With ``event_time`` they are whole numbers, and break ties of it.
    """
    step = _Grow(order, event_time is not None)
    return in_order(stream, event_time).groupBy("seq_id").transformWithStateInPandas(step, STATE_ROWS, "append", _mode(event_time))


def run_available(stream: DataFrame, path: str, checkpoint: str, told: list | None = None) -> DataFrame:
    """Run a stream over what has arrived and read back its parquet output.

    The number of rows that came too late is added to ``told``.

    Keyed state needs the RocksDB store.  It is chosen for the session and stays chosen, so
    streams that run side by side do not change it under each other.
    """
    stream.sparkSession.conf.set(STORE, ROCKSDB)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if told is not None:
        told.append(late_rows(query))
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
