"""Queries on vectors and on automata of feature sequences."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import distance as D
from ..operators import rate, similarity
from ..operators.automaton import build_index
from ..operators.render import hann_window, notes_in_beats, top_pitches
from ..sources import sequences
from .catalog import register
from .index_queries import IR_SQL
from .machine_sql import ABS, COSINE, EUCLIDEAN, WORDS, automaton_ctes, embedding_frames, event_values

# -- distances between neighbouring vectors --------------------------------------------

PAIR = """(SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) p"""


def fold_sql(vec: str) -> str:
    """All components without sign, summed into 12 bins by their place."""
    bin_ = f"list_sum(list_transform(range(p + 1, len({vec}) + 1, 12), lambda i: abs(({vec})[i])))"
    return f"list_transform(range(0, 12), lambda p: {bin_})"


CHROMA = f"(SELECT vec_id, {fold_sql('a')} AS a, {fold_sql('b')} AS b FROM {PAIR})"


def _pairs(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("a")
    )
    after = table.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return table.join(after, "vec_id")


def chroma(vec) -> F.Column:
    """All components without sign, summed into 12 bins by their place, as a chroma vector."""

    def total(p):
        return F.aggregate(F.filter(vec, lambda _, i: i % 12 == p), F.lit(0.0), lambda s, v: s + F.abs(v))

    return F.transform(F.sequence(F.lit(0), F.lit(11)), total)


def _chroma_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", chroma(F.col("a")).alias("a"), chroma(F.col("b")).alias("b"))


def _centred(v):
    return f"list_transform({v}, lambda x: x - list_avg({v}))"


def _total(expr):
    return f"list_sum(list_transform(range(1, len(a) + 1), lambda i: {expr}))"


METRIC_SQL = {
    "sqeuclidean": _total("(a[i] - b[i]) * (a[i] - b[i])"),
    "euclidean": "list_distance(a, b)",
    "cityblock": _total("abs(a[i] - b[i])"),
    "chebyshev": "list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i])))",
    "cosine": "list_cosine_distance(a, b)",
    "correlation": f"list_cosine_distance({_centred('a')}, {_centred('b')})",
    "canberra": _total("abs(a[i] - b[i]) / (abs(a[i]) + abs(b[i]))"),
    "braycurtis": f"{_total('abs(a[i] - b[i])')} / {_total('abs(a[i] + b[i])')}",
    "hamming": f"{_total('CASE WHEN a[i] <> b[i] THEN 1 ELSE 0 END')} / len(a)",
}
for _name, _sql in METRIC_SQL.items():
    register(
        f"metric_{_name}",
        lambda spark, sf, m=_name: _pairs(spark, sf).select("vec_id", D.distance("a", "b", m).alias("d")),
        "", f"SELECT vec_id, {_sql} AS d FROM {PAIR}", ints=["vec_id"], reals=["d"],
    )


def _tonnetz_sql(v):
    axes = [
        f"{r} * list_sum(list_transform(range(1, 13), lambda i: {v}[i] * {f}({angle!r} * (i - 1))))"
        for r, angle in ((1.0, 7 * math.pi / 6), (1.0, 1.5 * math.pi), (0.5, 2 * math.pi / 3))
        for f in ("sin", "cos")
    ]
    return f"[{', '.join(axes)}]"


register(
    "tonnetz_distance",
    lambda spark, sf: _chroma_pairs(spark, sf).select("vec_id", D.tonnetz("a", "b").alias("d")), "",
    f"""SELECT vec_id, list_distance(list_transform(p, lambda x: x / list_sum(list_transform(p, lambda y: abs(y)))),
          list_transform(q, lambda x: x / list_sum(list_transform(q, lambda y: abs(y))))) AS d
        FROM (SELECT vec_id, {_tonnetz_sql("a")} AS p, {_tonnetz_sql("b")} AS q FROM {CHROMA})""",
    ints=["vec_id"], reals=["d"],
)
ROLL = "list_transform(range(0, 12), lambda j: a[1 + (j - s + 24) % 12])"
register(
    "rotations",
    lambda spark, sf: _chroma_pairs(spark, sf).select(
        "vec_id", F.posexplode(D.rotations(F.col("a"), 2, 2)).alias("k", "r")
    ).select("vec_id", "k", F.posexplode("r").alias("i", "x")), "",
    f"""SELECT vec_id, k, unnest(range(0, 12)) AS i, unnest({ROLL}) AS x
        FROM (SELECT *, unnest([0, 2, 4, -2, -4]) AS s, unnest([0, 1, 2, 3, 4]) AS k FROM {CHROMA})""",
    ints=["vec_id", "k", "i"], reals=["x"],
)
for _name, _step, _shifts in (("transposed_distance", None, "range(0, 12)"), ("transposed_distance_near", 1, "[0, 1, -1]")):
    register(
        _name,
        lambda spark, sf, step=_step: _chroma_pairs(spark, sf).select(
            "vec_id", D.transposed_distance(F.col("a"), F.col("b"), 1, step).alias("d")
        ), "",
        f"SELECT vec_id, min(list_distance({ROLL}, b)) AS d FROM (SELECT *, unnest({_shifts}) AS s FROM {CHROMA}) GROUP BY 1",
        ints=["vec_id"], reals=["d"],
    )


def _top_pitches(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_pitches(table.select("vec_id", chroma(F.col("embedding").cast("array<double>")).alias("item")), ["vec_id"])


register(
    "top_pitches", _top_pitches, "",
    """SELECT vec_id, 2 - r AS "rank", p + 60 AS pitch FROM (
         SELECT vec_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, p DESC) - 1 AS r FROM (
           SELECT vec_id, unnest(range(0, 12)) AS p,
             unnest(""" + fold_sql("embedding::DOUBLE[]") + """) AS x FROM embeddings))
       WHERE r < 3""",
    ints=["vec_id", "rank", "pitch"],
)


def _hann(spark, sf_dir):
    """The window value at every event's place in its user's block of 64 events."""
    items = sequences.number(sequences.event_values(spark, sf_dir))
    return items.select("seq_id", "pos", hann_window(64, (F.col("pos") - 1) % 64).alias("w"))


register(
    "hann_window", _hann, "",
    """SELECT user_id AS seq_id, pos, 0.5 - 0.5 * cos(2 * pi() * ((pos - 1) % 64) / 63) + 0.00001 AS w FROM (
         SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)""",
    ints=["seq_id", "pos"], reals=["w"],
)

HOUR = 3600.0


def _notes(spark, sf_dir):
    """Events as notes (pitch from the value, length from the id) against six-hour beats."""
    table = sequences.events(spark, sf_dir)
    start = (F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))).cast("double")
    notes = table.select(
        F.col("user_id").alias("seq_id"), start.alias("start"),
        (start + 600.0 * (F.col("event_id") % 100 + 1)).alias("end"),
        (F.floor("value") % 128).alias("pitch"), (F.col("event_type") == "error").alias("is_drum"),
    )
    beats = notes.select("seq_id", F.floor(F.col("start") / (6 * HOUR)).alias("beat")).distinct().select(
        "seq_id", "beat", (F.col("beat") * 6 * HOUR).alias("start"), ((F.col("beat") + 1) * 6 * HOUR).alias("end")
    )
    return notes_in_beats(notes, beats, bucket=12 * HOUR)


register(
    "notes_in_beats", _notes,
    """nt AS (SELECT user_id AS seq_id, epoch(date_trunc('second', ts)) AS n0,
         epoch(date_trunc('second', ts)) + 600.0 * (event_id % 100 + 1) AS n1,
         floor(value)::BIGINT % 128 AS pitch, event_type = 'error' AS drum FROM events),
       bt AS (SELECT *, beat * 21600.0 AS b0, (beat + 1) * 21600.0 AS b1
              FROM (SELECT DISTINCT seq_id, floor(n0 / 21600)::BIGINT AS beat FROM nt))""",
    """SELECT DISTINCT nt.seq_id, beat, pitch FROM nt JOIN bt ON nt.seq_id = bt.seq_id AND NOT drum
       AND ((n0 >= b0 AND n0 < b1) OR (n1 >= b0 AND n1 < b1) OR (n0 <= b0 AND n1 > b1))""",
    ints=["seq_id", "beat", "pitch"],
)

# -- automata of frames ----------------------------------------------------------------

VALUE_THRESHOLD = 20.0
COSINE_THRESHOLD = 0.85
SWEEP = rate.threshold_grid(0.6, 1.2, 0.05)
COARSE = rate.threshold_grid(0.7, 1.1, 0.1)


def value_index(spark, sf_dir, method="inc"):
    return build_index(
        sequences.event_values(spark, sf_dir), "variable", VALUE_THRESHOLD, "euclidean", method
    )


def embedding_index(spark, sf_dir, metric="cosine", threshold=COSINE_THRESHOLD):
    return build_index(sequences.embedding_frames(spark, sf_dir), "variable", threshold, metric)


VALUE = {m: automaton_ctes(event_values(VALUE_THRESHOLD), ABS, m == "complete") for m in ("inc", "complete")}
EMBEDDING = automaton_ctes(embedding_frames([COSINE_THRESHOLD]), COSINE)
STATE_COLUMNS = ["seq_id", "state", "sfx", "lrs", "label"]

for _method, _ctes in VALUE.items():
    register(
        f"frame_states_{_method}", lambda spark, sf, m=_method: value_index(spark, sf, m).states,
        _ctes, "SELECT * FROM st", ints=STATE_COLUMNS,
    )
    register(
        f"frame_links_{_method}", lambda spark, sf, m=_method: value_index(spark, sf, m).links(),
        _ctes, "SELECT * FROM ed", ints=["seq_id", "src", "dst"],
    )
register(
    "vector_states_cosine", lambda spark, sf: embedding_index(spark, sf).states, EMBEDDING,
    "SELECT * FROM st", ints=STATE_COLUMNS,
)
register(
    "vector_states_euclidean", lambda spark, sf: embedding_index(spark, sf, "euclidean", 1.3).states,
    automaton_ctes(embedding_frames([1.3]), EUCLIDEAN), "SELECT * FROM st", ints=STATE_COLUMNS,
)
register(
    "vector_states_custom_metric",
    lambda spark, sf: embedding_index(spark, sf, lambda x, others: abs(others - x).max(axis=1), 0.3).states,
    automaton_ctes(
        embedding_frames([0.3]),
        "list_max(list_transform(range(1, 65), lambda c: abs($a[c] - $b[c])))",
    ),
    "SELECT * FROM st", ints=STATE_COLUMNS,
)
register(
    "frame_clusters", lambda spark, sf: similarity.cluster_sizes(value_index(spark, sf)), VALUE["inc"],
    """SELECT seq_id, label, count(*) AS size, min(state) AS head, max(state) AS tail
       FROM st WHERE state > 0 GROUP BY ALL""",
    ints=["seq_id", "label", "size", "head", "tail"],
)


def _rates(kind):
    return lambda spark, sf: rate.threshold_rates(
        sequences.embedding_frames(spark, sf), SWEEP, "cosine", ir_type=kind
    )


for _kind in rate.IR_TYPES:
    register(
        f"threshold_rates_{_kind}", _rates(_kind),
        f"{automaton_ctes(embedding_frames(SWEEP), COSINE)},\n{WORDS}",
        f"""SELECT seq_id, thr AS threshold, sum(ir) AS ir, sum(h0) AS h0, sum(h1) AS h1
            FROM ({IR_SQL[_kind]}) GROUP BY ALL""",
        ints=["seq_id"], reals=["threshold", "ir", "h0", "h1"],
    )
register(
    "find_threshold",
    lambda spark, sf: rate.find_threshold(sequences.embedding_frames(spark, sf), SWEEP, metric="cosine"),
    f"{automaton_ctes(embedding_frames(SWEEP), COSINE)},\n{WORDS}",
    f"""SELECT seq_id, thr AS threshold, ir FROM (
          SELECT seq_id, thr, sum(ir) AS ir FROM ({IR_SQL["cum"]}) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY round(ir, 9) DESC, thr) = 1""",
    ints=["seq_id"], reals=["threshold", "ir"],
)
