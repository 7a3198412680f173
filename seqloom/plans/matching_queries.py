"""Query-by-content, tracking and recognition of embeddings against another label's model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hmm, matching, motifs
from ..operators.automaton import build_index
from ..sources import sequences
from .catalog import register
from .index_queries import PATTERN_SCAN
from .machine_sql import COSINE, automaton_ctes, embedding_frames
from .vector_queries import COSINE_THRESHOLD, EMBEDDING, chroma, embedding_index, fold_sql

REVERSED = automaton_ctes(
    embedding_frames([COSINE_THRESHOLD]).replace("ORDER BY vec_id)", "ORDER BY vec_id DESC)"), COSINE
)
# labels with their rank, and the label before each one in a circle
RANKED = """nb AS (SELECT label::BIGINT AS own, row_number() OVER (ORDER BY label) - 1 AS r, count(*) OVER () AS size
  FROM (SELECT DISTINCT label FROM embeddings)),
pv AS (SELECT x.own, y.own AS prev FROM nb x JOIN nb y ON y.r = (x.r + x.size - 1) % x.size)"""


def _matched(fn, ahead=(1,)):
    """``fn(index, frames, obs, pairs)``: every label's vectors meet the next labels' models."""

    def run(spark, sf_dir):
        frames = sequences.embedding_frames(spark, sf_dir)
        return fn(embedding_index(spark, sf_dir), frames, frames, sequences.meetings(frames, ahead))

    return run


def walk_sql(policy="forward_self", starts="cluster", ahead="[1]", expand=True, decay=1.0, smooth=False, chunk=None):
    """CTE ``wk(obs_id, seq_id, chunk, k, t, state, cost)``: the greedy walks."""
    own = "f.trn[p + 1]"
    up = "f.trn[f.sfx[p + 1] + 1]"
    base = {
        "forward": f"CASE WHEN len({own}) = 0 THEN {up} ELSE {own} END",
        "forward_self": f"(CASE WHEN len({own}) = 0 THEN {up} ELSE {own} END) || [p]",
        "suffix": f"""CASE WHEN len({own}) = 0 THEN {up}
            ELSE {own} || coalesce(f.trn[list_position(f.sfx[2:], p) + 1], []) || {up} END""",
    }[policy]
    each = "mem[f.lab[j + 1] + 1]" if expand else "[j]"
    d = "list_distance(x[c[i]], q[t + 1]) ** 2"
    if smooth:
        d = f"CASE WHEN state < n THEN 0.5 * {d} + 0.5 * list_distance(x[state + 1], x[c[i]]) ** 2 ELSE {d} END"
    first = {
        "cluster": """SELECT obs_id, seq_id, chunk, k, 1 AS t, arg_min(s, (d, s)) AS state, min(d) AS cost FROM (
            SELECT ob.obs_id, ob.seq_id, ob.chunk, st.label AS k, st.state AS s,
              list_distance(sq.x[st.state], ob.q[1]) ** 2 AS d
            FROM ob JOIN sq USING (seq_id) JOIN st ON st.seq_id = ob.seq_id AND st.state > 0) GROUP BY ALL""",
        "heads": """SELECT ob.obs_id, ob.seq_id, ob.chunk, st.label AS k, 1 AS t, st.state,
            list_distance(sq.x[st.state], ob.q[1]) ** 2 AS cost
            FROM ob JOIN sq USING (seq_id) JOIN st ON st.seq_id = ob.seq_id AND st.sfx = 0""",
        "reversed": f"""SELECT ob.obs_id, ob.seq_id, ob.chunk, r.k, 1 AS t, r.head AS state,
            list_distance(sq.x[r.head], ob.q[1]) ** 2 AS cost
            FROM ob JOIN sq USING (seq_id) JOIN (
              SELECT rv.seq_id, row_number() OVER (PARTITION BY rv.seq_id ORDER BY rv.state) - 1 AS k, h.state AS head
              FROM (WITH RECURSIVE {REVERSED} SELECT seq_id, state FROM st WHERE sfx = 0) rv
              JOIN sq ON sq.seq_id = rv.seq_id
              JOIN st a ON a.seq_id = rv.seq_id AND a.state = sq.n + 1 - rv.state
              JOIN st h ON h.seq_id = rv.seq_id AND h.label = a.label AND h.sfx = 0) r ON r.seq_id = ob.seq_id""",
        "one": """SELECT ob.obs_id, ob.seq_id, ob.chunk, 0 AS k, 1 AS t, 1 AS state,
            list_distance(sq.x[1], ob.q[1]) ** 2 AS cost FROM ob JOIN sq USING (seq_id)""",
    }[starts]
    parts = "0 AS chunk" if chunk is None else f"((pos - 1) // {chunk}) AS chunk"
    return f"""
mb AS (SELECT seq_id, list(m ORDER BY label) AS mem FROM (
  SELECT seq_id, label, list(state ORDER BY state) AS m FROM st WHERE state > 0 GROUP BY ALL) GROUP BY seq_id),
cand AS (
  SELECT seq_id, p, flatten(list_transform(base, lambda j: {each.replace("f.lab", "lab")})) AS c FROM (
    SELECT f.seq_id, p, f.lab, mem, {base} AS base
    FROM (SELECT seq_id, sfx, lab, trn, unnest(range(1, len(sfx)))::INTEGER AS p FROM fin) f JOIN mb USING (seq_id))
),
{RANKED},
ob AS (
  SELECT o.own AS obs_id, m.own AS seq_id, chunk, list(e ORDER BY vec_id) AS q FROM (
    SELECT *, {parts}, unnest({ahead}) AS a FROM (
      SELECT label, vec_id, embedding::DOUBLE[] AS e,
        row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings)) v
  JOIN nb o ON o.own = v.label JOIN nb m ON m.r = (o.r + a) % o.size GROUP BY ALL
),
wk AS (
  {first}
  UNION ALL
  SELECT obs_id, seq_id, chunk, k, t + 1, c[best.i], {decay} * cost + best.d FROM (
    SELECT wk.*, c, list_min(list_transform(range(1, len(c) + 1), lambda i: {{'d': {d}, 'i': i}})) AS best
    FROM wk JOIN cand ON cand.seq_id = wk.seq_id AND cand.p = wk.state
    JOIN sq ON sq.seq_id = wk.seq_id
    JOIN ob ON ob.obs_id = wk.obs_id AND ob.seq_id = wk.seq_id AND ob.chunk = wk.chunk
    WHERE t < len(q))
)"""


PATH = ["obs_id", "seq_id", "start", "t", "state"]
ALL_STEPS = "SELECT *, k AS start FROM wk"
CHEAPEST = """SELECT * FROM wk QUALIFY row_number() OVER (
    PARTITION BY obs_id, seq_id, t ORDER BY round(cost, 9), k) = 1"""

for _policy in matching.POLICIES:
    register(
        f"query_paths_{_policy}",
        _matched(lambda ix, fr, ob, pairs, p=_policy: matching.query_paths(ix, fr, ob, pairs, p)),
        f"{EMBEDDING}, {walk_sql(_policy)}", ALL_STEPS, ints=PATH, reals=["cost"],
    )
register(
    "query_paths_smooth",
    _matched(lambda ix, fr, ob, pairs: matching.query_paths(ix, fr, ob, pairs, smooth=True)),
    f"{EMBEDDING}, {walk_sql(smooth=True)}", ALL_STEPS, ints=PATH, reals=["cost"],
)
register(
    "query_best_path",
    _matched(lambda ix, fr, ob, pairs: matching.best_path(matching.query_paths(ix, fr, ob, pairs))),
    f"{EMBEDDING}, {walk_sql()}",
    """SELECT wk.*, wk.k AS start, total FROM wk JOIN (
         SELECT obs_id, seq_id, k, cost AS total FROM wk
         QUALIFY row_number() OVER (PARTITION BY obs_id, seq_id ORDER BY t DESC, cost, k) = 1) b
       ON wk.obs_id = b.obs_id AND wk.seq_id = b.seq_id AND wk.k = b.k""",
    ints=PATH, reals=["cost", "total"],
)
for _name, _policy, _decay in (("track", "forward_self", 1.0), ("track_suffix_decay", "suffix", 0.9)):
    register(
        _name,
        _matched(
            lambda ix, fr, ob, pairs, p=_policy, d=_decay: matching.track(ix, fr, ob, pairs, policy=p, decay=d)
        ),
        f"{EMBEDDING}, {walk_sql(_policy, 'heads', decay=_decay)}", CHEAPEST,
        ints=["obs_id", "seq_id", "t", "state"], reals=["cost"],
    )
register(
    "track_reverse_start",
    _matched(lambda ix, fr, ob, pairs: matching.track(ix, fr, ob, pairs, reverse_init=True)),
    f"{EMBEDDING}, {walk_sql(starts='reversed')}", CHEAPEST,
    ints=["obs_id", "seq_id", "t", "state"], reals=["cost"],
)
register(
    "align", _matched(lambda ix, fr, ob, pairs: matching.align(ix, fr, ob, pairs)),
    f"{EMBEDDING}, {walk_sql(starts='one')}", "SELECT * FROM wk",
    ints=["obs_id", "seq_id", "t", "state"], reals=["cost"],
)
register(
    "track_gestures", _matched(matching.track_gestures, ahead=(0, 1, 2)),
    f"{EMBEDDING}, {walk_sql(starts='one', ahead='[0, 1, 2]', expand=False)}",
    """SELECT obs_id, t, seq_id AS gesture, state, cost FROM wk QUALIFY row_number() OVER (
         PARTITION BY obs_id, t ORDER BY round(cost, 9), seq_id) = 1""",
    ints=["obs_id", "t", "gesture", "state"], reals=["cost"],
)
register(
    "query_with_continuity", _matched(matching.query_with_continuity),
    f"""{EMBEDDING}, {walk_sql(chunk=3)},
    bs AS (SELECT obs_id, seq_id, chunk, k FROM wk
           QUALIFY row_number() OVER (PARTITION BY obs_id, seq_id, chunk ORDER BY t DESC, cost, k) = 1),
    op AS (SELECT obs_id, seq_id, chunk, list([state] || fin.trn[state + 1] ORDER BY t) AS o
           FROM wk JOIN bs USING (obs_id, seq_id, chunk, k) JOIN fin USING (seq_id) GROUP BY ALL),
    mg AS (
      SELECT *, 1 AS a, 1 AS b, 1 AS c, 1e9::DOUBLE AS best, []::INTEGER[] AS pick FROM op WHERE len(o) > 1
      UNION ALL
      SELECT obs_id, seq_id, chunk, o, a + (mv = 'a')::INT, b + (mv = 'b')::INT, c + (mv = 'c')::INT,
        least(best, s), CASE WHEN s < best THEN now ELSE pick END
      FROM (SELECT *,
          CASE WHEN len(o) = 2 THEN CASE WHEN x < y THEN 'a' ELSE 'b' END
               WHEN x < y AND x < z THEN 'a' WHEN y < z THEN 'b' ELSE 'c' END AS mv,
          abs(x - y) + CASE WHEN len(o) = 3 THEN abs(y - z) ELSE 0 END AS s,
          CASE WHEN len(o) = 3 THEN [x, y, z] ELSE [x, y] END AS now
        FROM (SELECT *, o[1][a] AS x, o[2][b] AS y, o[3][c] AS z FROM mg
              WHERE a <= len(o[1]) AND b <= len(o[2]) AND (len(o) = 2 OR c <= len(o[3]))))
    ),
    dn AS (
      SELECT obs_id, seq_id, chunk, pick FROM mg QUALIFY row_number() OVER (
        PARTITION BY obs_id, seq_id, chunk ORDER BY a + b + c DESC) = 1
      UNION ALL SELECT obs_id, seq_id, chunk, [list_min(o[1])] FROM op WHERE len(o) = 1)""",
    """SELECT obs_id, seq_id, chunk * 3 + unnest(range(1, len(pick) + 1)) AS t, unnest(pick) AS state FROM dn""",
    ints=["obs_id", "seq_id", "t", "state"],
)


def _reverse(spark, sf_dir):
    return matching.reverse_index(embedding_index(spark, sf_dir), sequences.embedding_frames(spark, sf_dir)).states


register(
    "reverse_states", _reverse, REVERSED,
    "SELECT * FROM st", ints=["seq_id", "state", "sfx", "lrs", "label"],
)


def _pattern_automata(spark, sf_dir):
    ix = embedding_index(spark, sf_dir)
    patterns = motifs.find_repeated_patterns(ix)
    built = matching.pattern_automata(ix, sequences.embedding_frames(spark, sf_dir), patterns)
    return built.select("seq_id", "pattern", "state", F.explode("trn").alias("dst"))


register(
    "pattern_automata", _pattern_automata,
    f"""{EMBEDDING}, {PATTERN_SCAN},
    pc AS (SELECT *, unnest(range(0, len(ends))) AS occ, unnest(ends) AS e FROM pf),
    px AS (SELECT pc.seq_id || '/' || pattern || '/' || occ AS seq_id, thr, len AS n, x[e - len + 1:e] AS x
           FROM pc JOIN sq USING (seq_id)),
    pe AS (WITH RECURSIVE {automaton_ctes("sq AS (SELECT * FROM px)", COSINE)} SELECT seq_id, src, dst FROM ed)""",
    """SELECT DISTINCT split_part(seq_id, '/', 1) AS seq_id, split_part(seq_id, '/', 2) AS pattern,
         src AS state, dst FROM pe""",
    ints=["seq_id", "pattern", "state", "dst"],
)

# -- hidden-Markov recognition ---------------------------------------------------------

CHROMA_THRESHOLD = 0.06
CHROMA = automaton_ctes(
    f"""sq AS (
  SELECT label::BIGINT AS seq_id, {CHROMA_THRESHOLD} AS thr, count(*) AS n,
    list({fold_sql('embedding::DOUBLE[]')} ORDER BY vec_id) AS x
  FROM embeddings GROUP BY label)""",
    COSINE,
)


def chroma_frames(spark, sf_dir, table=None):
    frames = sequences.embedding_frames(spark, sf_dir, table)
    return frames.withColumn("item", chroma(F.col("item")))


def chroma_index(frames):
    return build_index(frames, "variable", CHROMA_THRESHOLD, "cosine")


def _medians(spark, sf_dir):
    frames = chroma_frames(spark, sf_dir)
    return hmm.cluster_medians(chroma_index(frames), frames)


def on_model_before(frames, known):
    """Frames of every sequence under the id of the one before it among the ``known``."""
    before = sequences.meetings(known, (-1,)).withColumnRenamed("seq_id", "before")
    met = frames.withColumnRenamed("seq_id", "obs_id").join(before, "obs_id")
    return met.withColumnRenamed("before", "seq_id").drop("obs_id")


def _recognition(spark, sf_dir):
    """Every label's chroma frames scored on the next label's model."""
    frames = chroma_frames(spark, sf_dir)
    obs = on_model_before(frames, frames)
    return hmm.recognition(chroma_index(frames), frames, obs, order=1)


MEDIANS = """md AS (
  SELECT seq_id, label, dim, median(v) AS med FROM (
    SELECT st.seq_id, label, unnest(range(0, 12)) AS dim, unnest(x[state]) AS v
    FROM st JOIN sq USING (seq_id) WHERE state > 0) GROUP BY ALL)"""
LOG_A = """kk AS (SELECT seq_id, count(*) AS kn FROM st WHERE sfx = 0 GROUP BY 1),
pa AS (SELECT a.seq_id, a.label AS i, b.label AS j, count(*) AS n FROM st a
       JOIN st b ON a.seq_id = b.seq_id AND b.state = a.state + 1 WHERE a.state > 0 GROUP BY ALL),
la AS (
  SELECT seq_id, i, j, ln(w / sum(w) OVER (PARTITION BY seq_id, i)) AS a FROM (
    SELECT g.seq_id, g.i, g.j, coalesce(pa.n / sum(pa.n) OVER (PARTITION BY g.seq_id, g.i), 0)
      + 2.220446049250313e-16 + 1 AS w
    FROM (SELECT seq_id, i, unnest(range(0, kn)) AS j
          FROM (SELECT seq_id, kn, unnest(range(0, kn)) AS i FROM kk)) g
    LEFT JOIN pa ON pa.seq_id = g.seq_id AND pa.i = g.i AND pa.j = g.j)),
lm AS (SELECT seq_id, j, list(a ORDER BY i) AS col FROM la GROUP BY ALL)"""
register(
    "cluster_medians", _medians, f"{CHROMA}, {MEDIANS}", "SELECT * FROM md",
    ints=["seq_id", "label", "dim"], reals=["med"],
)
register(
    "recognition", _recognition,
    f"""{CHROMA}, {MEDIANS}, {LOG_A},
    mn AS (SELECT seq_id, label, list((med + 2.220446049250313e-16) / s ORDER BY dim) AS mean FROM (
      SELECT *, sum(med + 2.220446049250313e-16) OVER (PARTITION BY seq_id, label) AS s FROM md) GROUP BY ALL),
    {RANKED},
    em AS (SELECT mn.seq_id, o.t, label, ln(list_dot_product(mean, o.x)) AS e FROM mn JOIN (
      SELECT prev AS seq_id, unnest(range(1, n + 1)) AS t, unnest(x) AS x FROM sq JOIN pv ON pv.own = sq.seq_id) o
      ON o.seq_id = mn.seq_id),
    et AS (SELECT seq_id, t, list(e ORDER BY label) AS e FROM em GROUP BY ALL),
    cols AS (SELECT seq_id, list(col ORDER BY j) AS cols FROM lm GROUP BY ALL),
    vt AS (
      SELECT seq_id, t, list_transform(e, lambda y: y - ln(kn)) AS v FROM et JOIN kk USING (seq_id) WHERE t = 1
      UNION ALL
      SELECT vt.seq_id, vt.t + 1, list_transform(range(1, len(v) + 1), lambda j: et.e[j] +
        list_max(list_transform(range(1, len(v) + 1), lambda i: v[i] + cols[j][i])))
      FROM vt JOIN et ON et.seq_id = vt.seq_id AND et.t = vt.t + 1 JOIN cols ON cols.seq_id = vt.seq_id
    ),
    bk AS (
      SELECT vt.seq_id, t, unnest(range(0, len(v))) AS label, unnest(v) AS score,
        unnest(list_transform(range(1, len(v) + 1), lambda j: list_min(list_transform(range(1, len(v) + 1),
          lambda i: {{'c': -(v[i] + cols[j][i]), 'i': i - 1}})).i)) AS back
      FROM vt JOIN cols USING (seq_id))""",
    """SELECT seq_id, t, label, score,
         CASE WHEN t < max(t) OVER (PARTITION BY seq_id) THEN back END AS back FROM bk""",
    ints=["seq_id", "t", "label", "back"], reals=["score"],
)
