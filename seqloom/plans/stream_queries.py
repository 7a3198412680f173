"""Tracking and streaming queries over the event and embedding tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..operators import tracker
from ..operators.rate import threshold_grid
from ..session import checkpoint_dir
from ..sources import sequences
from ..streaming import frames, live
from .catalog import register
from .index_queries import FO, IR_SQL
from .machine_sql import COSINE, WORDS, automaton_ctes
from .matching_queries import LOG_A, MEDIANS, RANKED, chroma_frames, on_model_before
from .vector_queries import VALUE, VALUE_THRESHOLD, fold_sql

GRID = threshold_grid(0.0, 1.0, 0.001)  # the operator's own


def _track(rule, decay):
    def run(spark, sf_dir):
        known = chroma_frames(spark, sf_dir)
        return tracker.track(tracker.fit(known, GRID), on_model_before(known, known), decay, rule)

    return run


def _live_dirs(spark):
    base = f"{checkpoint_dir(spark)}/live-{uuid.uuid4()}"
    return f"{base}/rows", f"{base}/checkpoint"


def _stream(spark, sf_dir, table):
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _track_stream(spark, sf_dir):
    known = chroma_frames(spark, sf_dir)
    models = tracker.fit(known, GRID)
    obs = chroma_frames(spark, sf_dir, _stream(spark, sf_dir, "embeddings"))
    flat = on_model_before(obs, known).select("seq_id", F.col("ord.vec_id").alias("pos"), "item")
    return live.run_available(live.track_stream(flat, models), *_live_dirs(spark))


def _grow_stream(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    flat = events.select(F.col("user_id").alias("seq_id"), "ts", "event_id", F.col("event_type").alias("item"))
    return live.run_available(live.grow_stream(flat, ["ts", "event_id"]), *_live_dirs(spark))


def _grow_frames(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    flat = events.select(
        F.col("user_id").alias("seq_id"), "ts", "event_id", F.array(F.col("value").cast("double")).alias("item")
    )
    grown = frames.grow_frames(flat, VALUE_THRESHOLD, "euclidean", ["ts", "event_id"])
    return live.run_available(grown, *_live_dirs(spark))


def _own_thresholds(text):
    """The same CTEs on the states of each sequence's best threshold."""
    return re.sub(r"\bsq\b", "bq", re.sub(r"\bst\b", "bt", text))


SOURCE = f"""sq AS (
  SELECT label::BIGINT AS seq_id, g.thr, count(*) AS n,
    list({fold_sql('embedding::DOUBLE[]')} ORDER BY vec_id) AS x
  FROM embeddings, (VALUES {", ".join(f"({t!r}::DOUBLE)" for t in GRID)}) g(thr) GROUP BY label, g.thr)"""
MODEL = f"""{automaton_ctes(SOURCE, COSINE)}, {WORDS},
best AS (
  SELECT seq_id, thr FROM (SELECT seq_id, thr, sum(ir) AS ir FROM ({IR_SQL["cum"]}) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY round(ir, 9) DESC, thr) = 1),
bt AS (SELECT st.* FROM st JOIN best ON st.seq_id = best.seq_id AND st.thr = best.thr),
bq AS (SELECT sq.* FROM sq JOIN best ON sq.seq_id = best.seq_id AND sq.thr = best.thr),
{_own_thresholds(MEDIANS)}, {_own_thresholds(LOG_A)},
cols AS (SELECT seq_id, list(col ORDER BY j) AS cols FROM lm GROUP BY ALL),
mb AS (SELECT seq_id, list(m ORDER BY label) AS mem FROM (
  SELECT seq_id, label, list(state ORDER BY state) AS m FROM bt WHERE state > 0 GROUP BY ALL) GROUP BY seq_id),
mv AS (SELECT seq_id, label, list(med ORDER BY dim) AS med FROM md GROUP BY ALL),
{RANKED},
em AS (
  SELECT seq_id, t, list(ln((2 - list_cosine_distance(med, o.x) + 2.220446049250313e-16) / 2) ORDER BY label) AS e
  FROM mv JOIN (SELECT prev AS seq_id, unnest(range(1, n + 1)) AS t, unnest(x) AS x
                FROM bq JOIN pv ON pv.own = bq.seq_id) o USING (seq_id) GROUP BY ALL)"""


def follow_sql(rule, decay):
    first = "1" if rule == "predicted" else "list_position(v, list_max(v))"
    pick = "step" if rule == "predicted" else "v"
    return f"""{MODEL},
tr AS (
  SELECT seq_id, t, v, mem[{first}][1] AS cur FROM (
    SELECT em.seq_id, t, list_transform(e, lambda y: y - ln(len(e))) AS v, mem
    FROM em JOIN mb USING (seq_id) WHERE t = 1)
  UNION ALL
  SELECT seq_id, t, v, CASE WHEN list_contains(m, cur + 1) THEN cur + 1
    ELSE list_min(list_transform(m, lambda s: {{'d': abs(s - cur), 's': s}})).s END
  FROM (SELECT *, mem[list_position({pick}, list_max({pick}))] AS m FROM (
    SELECT *, list_transform(range(1, len(step) + 1), lambda j: step[j] + e[j]) AS v FROM (
      SELECT tr.seq_id, em.t, em.e, cur, mem, list_transform(range(1, len(v) + 1), lambda j:
        list_max(list_transform(range(1, len(v) + 1), lambda i: {decay} * v[i] + cols[j][i]))) AS step
      FROM tr JOIN em ON em.seq_id = tr.seq_id AND em.t = tr.t + 1
      JOIN cols ON cols.seq_id = tr.seq_id JOIN mb ON mb.seq_id = tr.seq_id)))
)"""


FRAMES = "SELECT seq_id, t, cur - 1 AS frame FROM tr"
for _rule, _decay in (("predicted", 1.0), ("observed", 0.9)):
    register(
        f"follow_{_rule}", _track(_rule, _decay), follow_sql(_rule, _decay), FRAMES,
        ints=["seq_id", "t", "frame"],
    )
register(
    "follow_stream", _track_stream, follow_sql("predicted", 1.0), FRAMES, ints=["seq_id", "t", "frame"]
)
register(
    "grow_stream", _grow_stream, FO, "SELECT * FROM st WHERE state > 0",
    ints=["seq_id", "state", "sfx", "lrs", "label"],
)
register(
    "grow_stream_frames", _grow_frames, VALUE["inc"], "SELECT * FROM st WHERE state > 0",
    ints=["seq_id", "state", "sfx", "lrs", "label"],
)
