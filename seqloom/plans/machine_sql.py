"""DuckDB SQL that derives the automaton from its step rules, for cross-checking.

A recursive query advances every sequence by one elementary move per iteration: climb
one suffix link, compare two suffix contexts, or close the state.
"""

from __future__ import annotations


def automaton_ctes(source: str, apart: str, exhaustive: bool = False) -> str:
    """CTEs ``st`` (states) and ``ed`` (forward links) from ``sq(seq_id, thr, n, x)``.

    ``source`` defines ``sq``; ``apart`` is the distance of list elements ``a`` and ``b``.
    """
    near = apart.replace("$a", "x[t]").replace("$b", "x[i]")
    after_hit = "k_up" if exhaustive else "k"
    phase_hit = "0" if exhaustive else "1"
    return f"""
{source},
m AS (
  SELECT seq_id, thr, 1 AS i, -1 AS k, 0 AS below, NULL::STRUCT(d DOUBLE, t INTEGER) AS best,
         -1 AS p, 0 AS ph, [-1] AS sfx, [0] AS lrs, [-1] AS lab, [[1]] AS trn, 0 AS fresh
  FROM sq
  UNION ALL
  SELECT seq_id, thr,
    CASE WHEN done THEN i + 1 ELSE i END,
    CASE WHEN done THEN s WHEN act = 'up' THEN k_up WHEN act = 'hit' THEN {after_hit} ELSE k END,
    CASE WHEN done THEN i WHEN act = 'up' THEN k ELSE below END,
    CASE WHEN done THEN NULL
         WHEN act = 'hit' AND (best IS NULL OR hit.d < best.d) THEN hit ELSE best END,
    CASE WHEN act = 'turn' THEN best.t - 1
         WHEN act = 'hit' AND {phase_hit} = 1 THEN hit.t - 1
         WHEN act = 'climb' THEN sfx[p + 1] ELSE p END,
    CASE WHEN done THEN 0 WHEN act = 'turn' THEN 1 WHEN act = 'hit' THEN {phase_hit} ELSE ph END,
    CASE WHEN done THEN list_append(sfx, s) ELSE sfx END,
    CASE WHEN done THEN list_append(lrs, l) ELSE lrs END,
    CASE WHEN done THEN list_append(lab, CASE WHEN act = 'new' THEN fresh ELSE lab[best.t + 1] END)
         ELSE lab END,
    CASE WHEN done THEN list_append(trn, [i + 1])
         WHEN act = 'up' THEN trn[1:k] || [list_append(trn[k + 1], i)] || trn[k + 2:]
         ELSE trn END,
    CASE WHEN act = 'new' THEN fresh + 1 ELSE fresh END
  FROM (
    SELECT *, act IN ('new', 'close') AS done,
      CASE WHEN act = 'new' THEN 0 WHEN twin IS NULL THEN best.t ELSE twin END AS s,
      CASE WHEN act = 'new' THEN 0 WHEN twin IS NULL THEN l0 ELSE l0 + 1 END AS l
    FROM (
      SELECT *, CASE WHEN act = 'close' THEN list_min(list_filter(range(1, i), lambda j:
          sfx[j + 1] = best.t AND lrs[j + 1] = l0
          AND lab[j - l0 + 1] = lab[i - l0 + 1])) END::INTEGER AS twin
      FROM (
        SELECT *,
          CASE WHEN ph = 0 AND k = -1 AND best IS NULL THEN 'new'
               WHEN ph = 0 AND k = -1 THEN 'turn'
               WHEN ph = 0 AND hit IS NULL THEN 'up'
               WHEN ph = 0 THEN 'hit'
               WHEN p = sfx[below + 1] OR sfx[p + 1] = sfx[below + 1] OR p = 0 THEN 'close'
               ELSE 'climb' END AS act,
          CASE WHEN k >= 0 THEN sfx[k + 1] ELSE -1 END AS k_up,
          1 + CASE WHEN p = sfx[below + 1] THEN lrs[below + 1]
                   ELSE least(lrs[below + 1], lrs[p + 1]) END AS l0
        FROM (
          SELECT m.*, sq.x, CASE WHEN ph = 0 AND k >= 0 THEN
            list_min(list_transform(
              list_filter(trn[k + 1], lambda t: ({near}) < m.thr),
              lambda t: {{'d': ({near})::DOUBLE, 't': t::INTEGER}})) END AS hit
          FROM m JOIN sq ON m.seq_id = sq.seq_id AND m.thr = sq.thr WHERE i <= n))))
),
fin AS (SELECT m.* REPLACE (trn[1:n] || [[]::INTEGER[]] AS trn) FROM m JOIN sq ON m.seq_id = sq.seq_id AND m.thr = sq.thr WHERE m.i = sq.n + 1),
st AS (
  SELECT seq_id, thr, u.s::INTEGER AS state, nullif(sfx[u.s + 1], -1) AS sfx, lrs[u.s + 1] AS lrs,
         nullif(lab[u.s + 1], -1) AS label
  FROM fin, LATERAL (SELECT unnest(range(0, len(sfx))) AS s) u
),
ed AS (
  SELECT seq_id, thr, src, unnest(t) AS dst FROM (
    SELECT seq_id, thr, u.s::INTEGER AS src, trn[u.s + 1] AS t, len(sfx) - 1 AS n
    FROM fin, LATERAL (SELECT unnest(range(0, len(sfx))) AS s) u) WHERE src < n
)"""


EVENT_SYMBOLS = """sq AS (
  SELECT user_id AS seq_id, 0.5 AS thr, count(*) AS n, list(event_type ORDER BY ts, event_id) AS x
  FROM events GROUP BY user_id)"""

SAME = "CASE WHEN $a = $b THEN 0 ELSE 1 END"


def event_values(threshold: float) -> str:
    return f"""sq AS (
  SELECT user_id AS seq_id, {threshold} AS thr, count(*) AS n, list(value ORDER BY ts, event_id) AS x
  FROM events GROUP BY user_id)"""


ABS = "abs($a - $b)"


def embedding_frames(thresholds) -> str:
    grid = ", ".join(f"({t!r}::DOUBLE)" for t in thresholds)
    return f"""sq AS (
  SELECT label::BIGINT AS seq_id, g.thr, count(*) AS n, list(embedding::DOUBLE[] ORDER BY vec_id) AS x
  FROM embeddings, (VALUES {grid}) g(thr) GROUP BY label, g.thr)"""


COSINE = "list_cosine_distance($a, $b)"
EUCLIDEAN = "list_distance($a, $b)"

WORDS = """wp AS (
  SELECT seq_id, thr, NULL::BIGINT AS j, 0::BIGINT AS e FROM fin
  UNION ALL
  SELECT w.seq_id, w.thr, w.e, greatest(w.e + 1, coalesce(list_min(list_filter(
      range(w.e + 1, len(f.lrs)), lambda q: q - f.lrs[q + 1] > w.e)), len(f.lrs)) - 1)
  FROM wp w JOIN fin f ON w.seq_id = f.seq_id AND w.thr = f.thr WHERE w.e < len(f.lrs) - 1
),
wd AS (
  SELECT w.seq_id, w.thr, j, e, CASE WHEN f.lrs[e + 1] = 0 THEN 0 ELSE e - j END AS len,
    CASE WHEN f.lrs[e + 1] = 0 THEN e ELSE f.sfx[e + 1] - (e - j) + 1 END AS pos,
    f.sfx[e + 1] AS sfx, f.lrs[e + 1] AS lrs
  FROM wp w JOIN fin f ON w.seq_id = f.seq_id AND w.thr = f.thr WHERE j IS NOT NULL
),
fr AS (
  SELECT st.*, wd.j AS word, wd.e AS word_end FROM st JOIN wd
  ON st.seq_id = wd.seq_id AND st.thr = wd.thr AND st.state > wd.j AND st.state <= wd.e
)"""
