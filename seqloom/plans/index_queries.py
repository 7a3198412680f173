"""Queries on symbolic automata of event types per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import uniform_sql
from ..operators import generation, hmm, motifs, parse, predict, rate, similarity, tours
from ..operators.automaton import build_index
from ..operators.render import drawing, overlap_add, segment_lines
from ..sources import sequences
from .catalog import register
from .machine_sql import EVENT_SYMBOLS, SAME, WORDS, automaton_ctes

FO = automaton_ctes(EVENT_SYMBOLS, SAME)
PARSED = f"{FO},\n{WORDS}"


def _index(spark, sf_dir):
    return build_index(sequences.event_symbols(spark, sf_dir))


def on_index(fn):
    return lambda spark, sf_dir: fn(_index(spark, sf_dir))


# -- the automaton ---------------------------------------------------------------------

register(
    "symbol_states", on_index(lambda ix: ix.states), FO, "SELECT * FROM st",
    ints=["seq_id", "state", "sfx", "lrs", "label"],
)
register(
    "symbol_forward_links", on_index(lambda ix: ix.links()), FO, "SELECT * FROM ed",
    ints=["seq_id", "src", "dst"],
)
register(
    "symbol_suffix_links", on_index(lambda ix: ix.suffix_links()), FO,
    "SELECT seq_id, state AS src, sfx AS dst FROM st WHERE state > 0", ints=["seq_id", "src", "dst"],
)
register(
    "symbol_alphabet", on_index(similarity.alphabet), "",
    """SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY head) - 1 AS label, head
       FROM (SELECT user_id, event_type, min(pos) AS head FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
         GROUP BY ALL)""",
    ints=["seq_id", "label", "head"],
)
register(
    "symbol_clusters", on_index(similarity.clusters), "",
    """SELECT user_id AS seq_id, pos AS state, dense_rank() OVER (PARTITION BY user_id ORDER BY head) - 1 AS label
       FROM (SELECT *, min(pos) OVER (PARTITION BY user_id, event_type) AS head FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events))""",
    ints=["seq_id", "state", "label"],
)
register(
    "cluster_count",
    on_index(lambda ix: similarity.alphabet(ix).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))), "",
    "SELECT user_id AS seq_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1",
    ints=["seq_id", "n"],
)
register(
    "one_hot_labels", on_index(similarity.one_hot), FO,
    """SELECT seq_id, state, label, count(*) FILTER (sfx = 0) OVER (PARTITION BY seq_id) AS n_labels
       FROM st WHERE state > 0""",
    ints=["seq_id", "state", "label", "n_labels"],
)
register(
    "running_repeat_lengths", on_index(similarity.running_lengths), FO,
    """SELECT seq_id, state, lrs, max(lrs) OVER w AS max_lrs, avg(lrs) OVER w AS avg_lrs
       FROM st WHERE state > 0
       WINDOW w AS (PARTITION BY seq_id ORDER BY state ROWS UNBOUNDED PRECEDING)""",
    ints=["seq_id", "state", "lrs", "max_lrs"], reals=["avg_lrs"],
)
register(
    "suffix_ancestors", on_index(similarity.ancestors),
    f"""{FO}, an AS (
      SELECT seq_id, state, sfx AS ancestor, 1 AS hops FROM st WHERE sfx > 0
      UNION ALL
      SELECT an.seq_id, an.state, st.sfx, hops + 1 FROM an
      JOIN st ON an.seq_id = st.seq_id AND an.ancestor = st.state WHERE st.sfx > 0)""",
    "SELECT * FROM an", ints=["seq_id", "state", "ancestor", "hops"],
)
register(
    "suffix_subtrees", on_index(tours.subtrees),
    f"""{FO}, an AS (
      SELECT seq_id, state, sfx AS ancestor FROM st WHERE state > 0
      UNION ALL
      SELECT an.seq_id, an.state, st.sfx FROM an
      JOIN st ON an.seq_id = st.seq_id AND an.ancestor = st.state WHERE st.state > 0)""",
    """SELECT seq_id, state, coalesce(below, 0) AS below, coalesce(chain, 0) AS chain
       FROM st LEFT JOIN (SELECT seq_id, ancestor AS state, count(*) AS below FROM an GROUP BY ALL) USING (seq_id, state)
       LEFT JOIN (SELECT seq_id, state, count(*) AS chain FROM an GROUP BY ALL) USING (seq_id, state)""",
    ints=["seq_id", "state", "below", "chain"],
)

# -- parse and information rate --------------------------------------------------------

register(
    "code_words", on_index(parse.encode), PARSED, "SELECT *, e AS \"end\" FROM wd",
    ints=["seq_id", "end", "len", "pos"],
)
SEGMENTS = f"""{PARSED},
sp AS (SELECT wd.*, wd.j + e - wd.sfx AS cut, f.lrs AS ll, f.sfx AS ss FROM wd
       JOIN fin f USING (seq_id) WHERE wd.lrs > 0 AND wd.sfx + wd.lrs > e),
sx AS (SELECT *, CASE WHEN cut >= e THEN cut ELSE coalesce(list_min(list_filter(range(cut + 1, e + 1),
       lambda q: ll[q + 1] - ll[cut + 1] < q - cut)) - 1, e) END AS stop FROM sp),
sg AS (
  SELECT seq_id, j AS word, 0 AS piece, len, pos, j AS "at" FROM wd WHERE NOT (lrs > 0 AND sfx + lrs > e)
  UNION ALL SELECT seq_id, j, 0, cut - j, pos, j FROM sx
  UNION ALL SELECT seq_id, j, 1, CASE WHEN stop = cut THEN 0 ELSE stop - cut END,
    CASE WHEN stop = cut THEN cut + 1 ELSE ss[stop + 1] - stop + cut + 1 END, cut FROM sx)"""
register(
    "non_overlapping_words", on_index(parse.segment), SEGMENTS, "SELECT * FROM sg",
    ints=["seq_id", "word", "piece", "len", "pos"],
)

ROWS = "(PARTITION BY seq_id, thr ORDER BY state ROWS UNBOUNDED PRECEDING)"
IR_SQL = {
    "cum": f"""SELECT seq_id, thr, state AS step, greatest(h0 - h1, 0) AS ir, h0, h1 FROM (
        SELECT *, log2(sum(CASE WHEN lrs = 0 THEN 1 ELSE 0 END) OVER w) AS h0,
          log2(sum(CASE WHEN state = word + 1 THEN 1 ELSE 0 END) OVER w) / (word_end - word) AS h1
        FROM fr WINDOW w AS {ROWS})""",
    "cum2": f"""SELECT seq_id, thr, state AS step, greatest(h0 - h1, 0) AS ir, h0, h1 FROM (
        SELECT *, log2(count(*) FILTER (sfx = 0) OVER w) AS h0,
          (log2(state) + log2(greatest(max(lrs) OVER w, 1))) / (word_end - word) AS h1
        FROM fr WINDOW w AS {ROWS})""",
    "cum3": f"""SELECT seq_id, thr, state AS step, greatest(h0 - h1, 0) AS ir, h0, h1 FROM (
        SELECT *, CASE WHEN lrs = 0 THEN h0 ELSE (h0 + log2(lrs)) / lrs END AS h1 FROM (
        SELECT *, log2(count(*) FILTER (sfx = 0) OVER w) AS h0 FROM fr WINDOW w AS {ROWS}))""",
    "fixed": """SELECT seq_id, thr, state AS step, greatest(h0 - h1 / (word_end - word), 0) AS ir, h0, h1 FROM (
        SELECT *, log2(count(*) FILTER (sfx = 0) OVER p) AS h0,
          log2(count(*) OVER p) + log2(greatest(max(lrs) OVER p, 1)) AS h1
        FROM fr WINDOW p AS (PARTITION BY seq_id, thr))""",
    "all": """SELECT seq_id, thr, e AS step, h0 - h1 AS ir, h0, h1 FROM (
        SELECT *, log2(count(*) FILTER (len = 0) OVER w) AS h0,
          CASE WHEN row_number() OVER w = 1 THEN 0 ELSE
            ln(sum(len + 1) OVER w) - sum((len + 1) * ln(len + 1)) OVER w / sum(len + 1) OVER w END AS h1
        FROM wd WINDOW w AS (PARTITION BY seq_id, thr ORDER BY e ROWS UNBOUNDED PRECEDING))""",
}
for _kind in rate.IR_TYPES:
    register(
        f"information_rate_{_kind}", on_index(lambda ix, kind=_kind: rate.information_rate(ix, kind)),
        PARSED, IR_SQL[_kind], ints=["seq_id", "step"], reals=["ir", "h0", "h1"],
    )


def _symbol_entropy(spark, sf_dir):
    counts = sequences.events(spark, sf_dir).groupBy("user_id", "event_type").count()
    return rate.entropy(counts, ["user_id"], "count").withColumnRenamed("user_id", "seq_id")


register(
    "symbol_entropy", _symbol_entropy, "",
    """SELECT user_id AS seq_id, -sum(p * ln(p)) AS entropy FROM (
         SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p
         FROM events GROUP BY user_id, event_type) GROUP BY 1""",
    ints=["seq_id"], reals=["entropy"],
)

# -- similarity and transitions --------------------------------------------------------

CELLS = """SELECT DISTINCT seq_id, u.i, u.j FROM ({runs}) r, LATERAL (
    SELECT unnest([a + d, b + d]) AS i, unnest([b + d, a + d]) AS j
    FROM (SELECT unnest(range(0, n)) AS d)) u"""
RUNS = {
    "sfx": (FO, "SELECT seq_id, state AS a, sfx AS b, 1 AS n FROM st WHERE sfx > 0"),
    "lrs": (FO, "SELECT seq_id, state - lrs + 1 AS a, sfx - lrs + 1 AS b, lrs AS n FROM st WHERE lrs > 0"),
    "com": (PARSED, "SELECT seq_id, j + 1 AS a, pos AS b, greatest(len, 1) AS n FROM wd"),
    "com_compat": (
        PARSED,
        """SELECT seq_id, coalesce(sum(len) OVER (PARTITION BY seq_id ORDER BY e
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS a, pos AS b,
             greatest(len, 1) AS n FROM wd""",
    ),
    "seg": (SEGMENTS, 'SELECT seq_id, "at" + 1 AS a, pos AS b, greatest(len, 1) AS n FROM sg'),
}
for _kind, (_ctes, _runs) in RUNS.items():
    _cells = CELLS.format(runs=_runs)
    if _kind == "seg":
        _cells = f"SELECT c.* FROM ({_cells}) c JOIN sq USING (seq_id) WHERE i <= n AND j <= n"
    register(
        f"self_similarity_{_kind}",
        on_index(
            lambda ix, kind=_kind: similarity.self_similarity(ix, kind.split("_")[0], kind.endswith("_compat"))
        ),
        _ctes, _cells, ints=["seq_id", "i", "j"],
    )
register(
    "self_similarity_rsfx", on_index(similarity.self_similarity), FO,
    """SELECT seq_id, state AS i, label, count(*) OVER (PARTITION BY seq_id, label) AS row_sum
       FROM st WHERE state > 0""",
    ints=["seq_id", "i", "label", "row_sum"],
)

SHARE = """SELECT *, n / sum(n) OVER (PARTITION BY seq_id, "from") AS prob,
    sum(n) OVER (PARTITION BY seq_id, "from") AS hist FROM (
    SELECT seq_id, "from", "to", count(*) AS n FROM ({pairs}) GROUP BY ALL)"""
PAIRS = {
    "seq": """SELECT a.seq_id, a.label AS "from", b.label AS "to" FROM st a
              JOIN st b ON a.seq_id = b.seq_id AND b.state = a.state + 1 WHERE a.state > 0""",
    "trn": """SELECT ed.seq_id, a.label AS "from", b.label AS "to" FROM ed
              JOIN st a ON a.seq_id = ed.seq_id AND a.state = src
              JOIN st b ON b.seq_id = ed.seq_id AND b.state = dst WHERE src > 0""",
}
for _kind, _pairs in PAIRS.items():
    register(
        f"transition_{_kind}", on_index(lambda ix, kind=_kind: similarity.transition(ix, kind)),
        FO, SHARE.format(pairs=_pairs),
        ints=["seq_id", "from", "to", "n", "hist"], reals=["prob"],
    )

# -- hidden-Markov tensor --------------------------------------------------------------

TENSOR = """SELECT seq_id, layer, "from", "to", n, hist, {prob} AS prob, {unseen} AS unseen FROM (
    SELECT *, sum(n) OVER (PARTITION BY seq_id, layer, "from") AS hist FROM (
      SELECT seq_id, layer, "from", "to", k, count(*) AS n FROM (
        SELECT b.seq_id, a.label AS "from", b.label AS "to", b.k,
          unnest(range(0, least(greatest(b.lrs - 1, 1), {layers}))) AS layer
        FROM st a JOIN (SELECT *, max(lrs) OVER (PARTITION BY seq_id) AS top,
             count(*) FILTER (sfx = 0) OVER (PARTITION BY seq_id) AS k FROM st) b
        ON a.seq_id = b.seq_id AND b.state = a.state + 1 WHERE a.state > 0)
      GROUP BY ALL))"""
register(
    "hmm_tensor", on_index(hmm.hmm_tensor), FO,
    TENSOR.format(prob="n / hist", unseen="0", layers="b.top - 1"),
    ints=["seq_id", "layer", "from", "to", "n", "hist"], reals=["prob", "unseen"],
)
register(
    "hmm_tensor_smooth", on_index(lambda ix: hmm.hmm_tensor(ix, 3, smooth=True)), FO,
    TENSOR.format(prob="(n + 1) / (hist + k)", unseen="1 / (hist + k)", layers="3"),
    ints=["seq_id", "layer", "from", "to", "n", "hist"], reals=["prob", "unseen"],
)

# -- patterns and fragments ------------------------------------------------------------

PATTERN_SCAN = """
pre AS (
  SELECT a.seq_id, a.state AS i, a.sfx::BIGINT AS s, a.lrs AS l, a.sfx > 0 AND a.lrs > 1 AS good,
    coalesce(list(b.state::BIGINT ORDER BY b.state) FILTER (b.state IS NOT NULL), []) AS kids,
    least(a.lrs, coalesce(min(b.lrs), a.lrs)) AS kl
  FROM st a LEFT JOIN st b ON b.seq_id = a.seq_id AND b.sfx = a.state WHERE a.state > 0
  GROUP BY a.seq_id, a.state, a.sfx, a.lrs
),
pt AS (
  SELECT seq_id, n AS i, -1 AS prev, []::STRUCT(id BIGINT, ends BIGINT[], len BIGINT)[] AS ps
  FROM sq
  UNION ALL
  SELECT seq_id, i - 1, CASE WHEN good THEN s ELSE -1 END,
    CASE WHEN NOT good THEN ps
      WHEN home IS NOT NULL THEN list_transform(range(1, len(ps) + 1), lambda p:
        CASE WHEN p = home THEN {'id': ps[p].id, 'ends': list_append(ps[p].ends, i), 'len': least(ps[p].len, l)}
             ELSE ps[p] END)
      WHEN prev - s <> 1 AND (len(kids) = 0 OR size > 1)
        THEN list_append(ps, {'id': i, 'ends': kids || [i, s], 'len': size})
      ELSE ps END
  FROM (
    SELECT pt.*, s, l, good, kids, CASE WHEN pt.i - kl + 1 < s THEN pt.i - s ELSE kl END AS size,
      CASE WHEN good THEN list_min(list_filter(range(1, len(ps) + 1), lambda p: list_contains(ps[p].ends, s)
        AND len(list_filter(ps[p].ends, lambda e: e - ps[p].len < pt.i AND pt.i < e)) = 0)) END AS home
    FROM pt JOIN pre ON pre.seq_id = pt.seq_id AND pre.i = pt.i WHERE pt.i >= 3)
),
pf AS (SELECT seq_id, p.id AS pattern, p.ends AS ends, p.len AS len
       FROM (SELECT seq_id, unnest(ps) AS p FROM pt WHERE i = 2))"""
PATTERNS = f"{FO}, {PATTERN_SCAN}"
register(
    "repeated_patterns",
    on_index(lambda ix: motifs.find_repeated_patterns(ix).select("*", F.posexplode("ends").alias("ord", "end"))),
    PATTERNS, 'SELECT seq_id, pattern, len, unnest(range(0, len(ends))) AS "ord", unnest(ends) AS "end" FROM pf',
    ints=["seq_id", "pattern", "len", "ord", "end"],
)
for _name, _less in (("pattern_matrix", 0), ("pattern_matrix_compat", 1)):
    register(
        _name,
        on_index(
            lambda ix, less=_less: motifs.pattern_matrix(motifs.find_repeated_patterns(ix), ix.keys, bool(less))
        ),
        PATTERNS,
        f"""SELECT DISTINCT seq_id, pattern, pos FROM (
              SELECT seq_id, pattern, unnest(range(e - len + 1, e + 1 - {_less})) AS pos
              FROM (SELECT *, unnest(ends) AS e FROM pf))""",
        ints=["seq_id", "pattern", "pos"],
    )
register(
    "fragments", on_index(motifs.find_fragments),
    f"""{FO},
    fg AS (
      SELECT seq_id, 0 AS frag, n AS "end", 0 AS len FROM sq
      UNION ALL
      SELECT seq_id, frag + 1, "end" - size, size FROM (
        SELECT fg.*, CASE WHEN l <= 1 THEN 1 WHEN y IS NULL THEN l ELSE "end" - y END AS size FROM (
          SELECT fg.*, f.lrs["end" + 1] AS l, list_max(list_filter(
            range("end" - f.lrs["end" + 1] + 1, "end"), lambda q: f.lrs[q + 1] > f.lrs["end" + 1])) AS y
          FROM fg JOIN fin f USING (seq_id) WHERE "end" > 0) fg) fg
    ),
    fl AS (SELECT seq_id, frag - 1 AS frag, "end" + len AS "end", len,
             count(*) OVER (PARTITION BY seq_id) AS k FROM fg WHERE frag > 0)""",
    """SELECT a.*, CASE WHEN b.frag > 0 THEN b.frag + a.k - 1 - a.frag ELSE 0 END AS link FROM fl a
       LEFT JOIN (SELECT seq_id, sfx, min(state) AS child FROM st GROUP BY ALL) c
         ON c.seq_id = a.seq_id AND c.sfx = a."end"
       LEFT JOIN fl b ON b.seq_id = a.seq_id AND b."end" = c.child""",
    ints=["seq_id", "frag", "end", "len", "link"],
)

# -- prediction ------------------------------------------------------------------------


def _contexts(seqs):
    """Seven contexts per sequence: two ends, two starts, a mix, one with a foreign symbol, a start backwards."""
    first, last = F.element_at("items", 1), F.element_at("items", -1)
    asked = F.array(
        F.slice("items", -2, 2), F.slice("items", 1, 3), F.array(last, first, last), F.array(F.lit("none"), last),
        F.expr("slice(items, greatest(size(items) - 7, 1), 8)"), F.slice("items", 1, 12), F.reverse(F.slice("items", 1, 6)),
    )
    packed = sequences.pack(seqs).select("seq_id", F.posexplode(asked).alias("ctx_id", "context"))
    return packed.withColumn("ctx_id", F.col("ctx_id").cast("long"))


ACCEPT = """
es AS (SELECT ed.seq_id, src, dst, x[dst] AS sym FROM ed JOIN sq USING (seq_id)),
cd AS (SELECT *, unnest(range(0, len(c) + 1)) AS d FROM ctx),
ac AS (
  SELECT seq_id, ctx_id, c, d, d AS k, 0 AS state, true AS ok FROM cd
  UNION ALL
  SELECT a.seq_id, a.ctx_id, a.c, a.d, a.k + 1, coalesce(e.dst, a.state), e.dst IS NOT NULL
  FROM ac a LEFT JOIN es e ON e.seq_id = a.seq_id AND e.src = a.state AND e.sym = a.c[a.k + 1]
  WHERE a.ok AND a.k < len(a.c)
),
af AS (SELECT seq_id, ctx_id, c, d, arg_max(state, k) AS state, arg_max(ok, k) AS ok FROM ac GROUP BY ALL)"""
PREDICT = f"""{ACCEPT},
an AS (
  SELECT seq_id, state, state AS top FROM st WHERE state > 0
  UNION ALL
  SELECT an.seq_id, an.state, st.sfx FROM an JOIN st ON an.seq_id = st.seq_id AND an.top = st.state
  WHERE st.sfx > 0
),
below AS (SELECT an.seq_id, top AS state, sym, count(*) AS n FROM an
          JOIN es ON es.seq_id = an.seq_id AND es.src = an.state GROUP BY ALL),
d1 AS (SELECT seq_id, ctx_id, min(d) AS d FROM af WHERE ok GROUP BY ALL),
like_it AS (SELECT af.seq_id, af.ctx_id, af.d, af.state, len(c) - af.d AS used, st.state AS j
            FROM af JOIN d1 ON af.seq_id = d1.seq_id AND af.ctx_id = d1.ctx_id AND af.d >= d1.d
            JOIN st ON st.seq_id = af.seq_id AND st.sfx = af.state AND st.lrs >= len(c) - af.d),
chosen AS (SELECT * FROM like_it QUALIFY d = min(d) OVER (PARTITION BY seq_id, ctx_id)),
seen AS (
  SELECT seq_id, ctx_id, sym, sum(n) AS n FROM (
    SELECT c.seq_id, ctx_id, sym, n FROM chosen c JOIN below b ON b.seq_id = c.seq_id AND b.state = c.j
    UNION ALL
    SELECT c.seq_id, ctx_id, sym, 1 FROM (SELECT DISTINCT seq_id, ctx_id, state FROM chosen) c
    JOIN es ON es.seq_id = c.seq_id AND es.src = c.state) GROUP BY ALL),
ab AS (SELECT DISTINCT seq_id, unnest(x) AS sym FROM sq),
pr AS (
  SELECT u.seq_id, u.ctx_id, u.used, ab.sym AS symbol, (1 + coalesce(n, 0))
    / sum(1 + coalesce(n, 0)) OVER (PARTITION BY u.seq_id, u.ctx_id) AS prob
  FROM (SELECT DISTINCT seq_id, ctx_id, used FROM chosen) u JOIN ab ON ab.seq_id = u.seq_id
  LEFT JOIN seen s ON s.seq_id = u.seq_id AND s.ctx_id = u.ctx_id AND s.sym = ab.sym)"""
CONTEXTS = """ctx AS (
  SELECT seq_id, unnest(range(0, 7)) AS ctx_id,
    unnest([x[-2:], x[:3], [x[-1], x[1], x[-1]], ['none', x[-1]],
      x[-8:], x[:12], list_reverse(x[:6])]) AS c FROM sq)"""


def _accept(spark, sf_dir):
    seqs = sequences.event_symbols(spark, sf_dir)
    return predict.accept(seqs, _contexts(seqs))


def _predict(spark, sf_dir):
    seqs = sequences.event_symbols(spark, sf_dir)
    return predict.predict(seqs, _contexts(seqs))


def _log_loss(spark, sf_dir):
    """Every user's events read backwards, under the model of the forward order."""
    seqs = sequences.event_symbols(spark, sf_dir)
    tests = sequences.reverse(seqs).withColumn("test_id", F.lit(0))
    return predict.log_loss(seqs, tests, m_order=2)


register(
    "accept_contexts", _accept, f"{FO}, {CONTEXTS}, {ACCEPT}",
    "SELECT seq_id, ctx_id, ok::INT AS accepted, state FROM af WHERE d = 0",
    ints=["seq_id", "ctx_id", "accepted", "state"],
)
register(
    "predict_next", _predict, f"{FO}, {CONTEXTS}, {PREDICT}", "SELECT * FROM pr",
    ints=["seq_id", "ctx_id", "used"], reals=["prob"], texts=["symbol"],
)
register(
    "log_loss", _log_loss,
    f"""{FO},
    ctx AS (
      SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY c) AS ctx_id, c FROM (
        SELECT seq_id, []::VARCHAR[] AS c FROM sq
        UNION SELECT seq_id, [unnest(list_distinct(x))] FROM sq
        UNION SELECT a.seq_id, [a.s, b.s] FROM (SELECT seq_id, unnest(list_distinct(x)) AS s FROM sq) a
          JOIN (SELECT seq_id, unnest(list_distinct(x)) AS s FROM sq) b ON a.seq_id = b.seq_id)),
    {PREDICT},
    pc AS (SELECT pr.*, ctx.c FROM pr JOIN ctx USING (seq_id, ctx_id)),
    ll AS (
      SELECT seq_id, 0 AS t, []::VARCHAR[] AS c, 0::DOUBLE AS bits, 0 AS size, list_reverse(x) AS test, n FROM sq
      UNION ALL
      SELECT seq_id, t + 1, c2, bits - log2(prob), size + len(c2), test, n FROM (
        SELECT ll.*, prob, list_append(CASE WHEN used = 0 THEN ll.c ELSE ll.c[-used:] END, test[t + 1])[-2:] AS c2
        FROM ll JOIN pc ON pc.seq_id = ll.seq_id AND pc.c = ll.c AND pc.symbol = test[t + 1] WHERE t < n)
    )""",
    "SELECT seq_id, bits / n AS log_loss, size / n AS mean_context FROM ll WHERE t = n",
    ints=["seq_id"], reals=["log_loss", "mean_context"],
)

# -- generation ------------------------------------------------------------------------


def _seeds(ix):
    return ix.states.where("state = 0").select("seq_id", F.col("seq_id").alias("seed"))


register(
    "jump_candidates", on_index(lambda ix: generation.jump_candidates(ix, lrs=1, weight="lrs")), FO,
    """SELECT seq_id, label, state + 1 AS next, lrs / sum(lrs) OVER (PARTITION BY seq_id, label) AS prob
       FROM st JOIN sq USING (seq_id) WHERE state > 0 AND state < n AND lrs >= 1""",
    ints=["seq_id", "label", "next"], reals=["prob"],
)
register(
    "jump_candidates_on_beat", on_index(lambda ix: generation.jump_candidates(ix, prune=4)), FO,
    """SELECT seq_id, label, state % 4 AS phase, state + 1 AS next,
         1 / count(*) OVER (PARTITION BY seq_id, label, state % 4) AS prob
       FROM st JOIN sq USING (seq_id) WHERE state > 0 AND state < n""",
    ints=["seq_id", "label", "phase", "next"], reals=["prob"],
)
register(
    "improvise", on_index(lambda ix: generation.improvise(ix, _seeds(ix), 40, lrs=2, continuity=2)),
    f"""{FO},
    im AS (
      SELECT seq_id, 0 AS step, CASE WHEN 3 < n THEN [1, 2]::BIGINT[] ELSE [] END AS walk,
        CASE WHEN 3 < n THEN 38 ELSE 40 END AS remaining FROM sq
      UNION ALL
      SELECT seq_id, step + 1,
        walk || [nxt] || CASE WHEN k2 + 2 < n THEN [k2, k2 + 1] ELSE [] END,
        remaining - 1 - CASE WHEN k2 + 2 < n THEN 2 ELSE 0 END
      FROM (SELECT *, CASE WHEN nxt + 1 < n THEN nxt + 1 ELSE 1 END AS k2 FROM (
        SELECT *, CASE WHEN len(able) > 0
            THEN able[1 + floor({uniform_sql("seq_id", "step", 1)} * len(able))::INT] + 1
            WHEN k = n THEN 1 ELSE k + 1 END AS nxt
        FROM (SELECT *, list_filter(range(1, n), lambda s: lab[s + 1] = lab[k + 1] AND lrs[s + 1] >= 2) AS able
          FROM (SELECT im.*, coalesce(im.walk[-1], 1) AS k, sq.n, f.lab, f.lrs
                FROM im JOIN sq USING (seq_id) JOIN fin f USING (seq_id) WHERE remaining > 0))))
    )""",
    """SELECT seq_id, unnest(range(0, len(walk))) AS step, unnest(walk) AS state
       FROM im WHERE remaining <= 0""",
    ints=["seq_id", "step", "state"],
)
def generate_sql(p, lrs, pick):
    """CTE ``ge`` with the generated walks; ``pick`` chooses from the list ``able``."""
    return f"""{FO},
an AS (
  SELECT seq_id, state AS k, state AS top FROM st WHERE state > 0
  UNION ALL
  SELECT an.seq_id, an.k, st.sfx FROM an JOIN st ON an.seq_id = st.seq_id AND an.top = st.state WHERE st.sfx > 0
),
kin AS (
  SELECT seq_id, k, list_sort(list_distinct(list(r))) AS rel FROM (
    SELECT an.seq_id, k, st.sfx AS r FROM an JOIN st ON st.seq_id = an.seq_id AND st.state = an.top
    UNION ALL
    SELECT an.seq_id, k, st.state FROM an JOIN st ON st.seq_id = an.seq_id AND st.sfx = an.top)
  GROUP BY ALL
),
ge AS (
  SELECT seq_id, 0 AS step, 1::BIGINT AS k, []::BIGINT[] AS walk FROM sq
  UNION ALL
  SELECT seq_id, step + 1, CASE WHEN nk >= n THEN 0 ELSE nk END,
    CASE WHEN quiet THEN walk ELSE list_append(walk, nk) END
  FROM (SELECT *, act = 'jump' AND s = n AS quiet,
      CASE act WHEN 'on' THEN CASE WHEN k < n THEN k + 1 ELSE sfx[k + 1] + 1 END
               WHEN 'link' THEN fwd[1 + floor(u1 * len(fwd))::INT]
               ELSE CASE WHEN s = n THEN sfx[s + 1] + 2 ELSE s + 1 END END::BIGINT AS nk
    FROM (SELECT *, CASE WHEN act = 'jump' THEN {pick} END AS s
      FROM (SELECT *, CASE WHEN k = 0 OR sfx[k + 1] = 0 THEN 'on' WHEN u0 < {p} THEN 'link'
               WHEN len(able) = 0 THEN 'on' ELSE 'jump' END AS act
        FROM (SELECT ge.*, sq.n, f.sfx, f.lrs,
            CASE WHEN len(f.trn[ge.k + 1]) = 0 THEN f.trn[f.sfx[ge.k + 1] + 1] ELSE f.trn[ge.k + 1] END AS fwd,
            list_filter(kin.rel, lambda s: f.lrs[s + 1] >= {lrs}) AS able,
            {uniform_sql("ge.seq_id", "step", 0)} AS u0, {uniform_sql("ge.seq_id", "step", 1)} AS u1,
            {uniform_sql("ge.seq_id", "step", 2)} AS u2
          FROM ge JOIN sq ON sq.seq_id = ge.seq_id JOIN fin f ON f.seq_id = ge.seq_id
          LEFT JOIN kin ON kin.seq_id = ge.seq_id AND kin.k = ge.k WHERE step < 60))))
)"""


UNIFORM = "able[1 + floor(u1 * len(able))::INT]"
REPEATS = "list_transform(able, lambda s: lrs[s + 1])"
TARGET = f"(list_max({REPEATS}) - floor(-ln(1 - u2)))"
GAP = f"list_min(list_transform({REPEATS}, lambda v: abs(v - {TARGET})))"
NEAR = f"list_filter(able, lambda s: abs(lrs[s + 1] - {TARGET}) = {GAP})"
PICKS = {
    "max": f"able[list_position({REPEATS}, list_max({REPEATS}))]",
    "weight": f"CASE WHEN {GAP} = 0 THEN {NEAR}[1 + floor(u1 * len({NEAR}))::INT] ELSE {NEAR}[1] END",
}
GENERATE = generate_sql(0.5, 1, UNIFORM)
WALKED = "SELECT seq_id, unnest(range(0, len(walk))) AS step, unnest(walk) AS state FROM ge WHERE step = 60"
register(
    "generate", on_index(lambda ix: generation.generate(ix, _seeds(ix), 60, p=0.5, lrs=1)), GENERATE, WALKED,
    ints=["seq_id", "step", "state"],
)
register(
    "generate_end",
    on_index(lambda ix: generation.generation_trace(ix, _seeds(ix), 60, p=0.5, lrs=1).where("step = 0")),
    GENERATE, "SELECT seq_id, k AS last FROM ge WHERE step = 60", ints=["seq_id", "last"],
)
for _weight in ("max", "weight"):
    register(
        f"generate_{_weight}",
        on_index(lambda ix, w=_weight: generation.generate(ix, _seeds(ix), 60, p=0.3, weight=w)),
        generate_sql(0.3, 0, PICKS[_weight]), WALKED,
        ints=["seq_id", "step", "state"],
    )

# -- rendering -------------------------------------------------------------------------


def _overlap_add(spark, sf_dir):
    """Event values as a signal, replayed by jumping to the successor of every suffix."""
    values = sequences.number(sequences.event_values(spark, sf_dir))
    samples = values.select("seq_id", (F.col("pos") - 1).alias("pos"), F.col("item")[0].alias("x"))
    ix = _index(spark, sf_dir)
    chosen = ix.frames.select("seq_id", (F.col("state") - 1).alias("step"), (F.col("sfx") + 1).alias("state"))
    return overlap_add(samples, chosen, size=8, hop=4)


register(
    "overlap_add", _overlap_add, FO,
    """SELECT seq_id, pos, CASE WHEN pos >= 4 AND pos < n * 4 + 4 - 4 THEN y / wsum ELSE y END AS y, wsum FROM (
         SELECT b.seq_id, n, b.step * 4 + o AS pos, sum(coalesce(v.value, 0) * w) AS y, sum(w) AS wsum FROM (
           SELECT st.seq_id, sq.n, state - 1 AS step, sfx * 4 + o AS src, o,
             0.5 - 0.5 * cos(2 * pi() * o / 7) + 0.00001 AS w
           FROM st JOIN sq USING (seq_id), (SELECT unnest(range(0, 8)) AS o) WHERE state > 0) b
         LEFT JOIN (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
                    FROM events) v ON v.user_id = b.seq_id AND v.pos = b.src
         GROUP BY ALL)""",
    ints=["seq_id", "pos"], reals=["y", "wsum"],
)


def _segment_lines(spark, sf_dir):
    """Code words as segments, in seconds since the user's first event."""
    table = sequences.events(spark, sf_dir)
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double")
    timed = sequences.symbols(table, "user_id", ["ts", "event_id"], seconds)
    begin = timed.groupBy("seq_id").agg(F.min("item").alias("begin"))
    beats = sequences.number(timed).join(begin, "seq_id").select(
        "seq_id", (F.col("pos") - 1).alias("beat"), (F.col("item") - F.col("begin")).alias("start")
    ).withColumn("end", F.col("start") + 1.0)
    ix = _index(spark, sf_dir)
    words = parse.encode(ix).select("seq_id", "word", "end")
    rank = ix.running(words, "end", sums={"seg": F.lit(1)})
    starts = rank.select("seq_id", (F.col("seg") - 1).alias("seg"), F.col("word").alias("beat"))
    close = rank.groupBy("seq_id").agg(F.max("seg").alias("seg"), (F.max("end") - 1).alias("beat"))
    return segment_lines(starts.unionByName(close), beats)


register(
    "segment_lines", _segment_lines, PARSED,
    """SELECT seq_id, seg, printf('%.3f', a.s) || chr(9) || printf('%.3f', CASE WHEN z THEN last + 1 ELSE b.s END)
         || chr(9) || printf('Seg#%03d', (seg + 1)::INT) AS line
       FROM (SELECT seq_id, j, e, row_number() OVER (PARTITION BY seq_id ORDER BY e) - 1 AS seg,
               e = max(e) OVER (PARTITION BY seq_id) AS z FROM wd) w
       JOIN (SELECT *, max(s) OVER (PARTITION BY user_id) AS last FROM tb) a ON a.user_id = seq_id AND a.p = j
       LEFT JOIN tb b ON b.user_id = seq_id AND b.p = e""".replace(
        "tb", """(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p,
          epoch_us(ts) / 1000000 - epoch_us(min(ts) OVER (PARTITION BY user_id)) / 1000000 AS s FROM events)"""),
    ints=["seq_id", "seg"], texts=["line"],
)
register(
    "drawing", on_index(drawing), FO,
    """SELECT seq_id, src, dst, kind, 3600.0 / size * (src + CASE WHEN kind = 'line' THEN 0.75 ELSE 0.5 END) AS x0,
         3600.0 / size * (dst + 0.5) AS x1,
         CASE WHEN kind = 'line' THEN 0 ELSE 800 + abs(dst - src) * 0.125 END AS arc FROM (
       SELECT l.*, n + 1 AS size FROM (
         SELECT seq_id, src, dst, CASE WHEN dst = src + 1 THEN 'line' ELSE 'forward' END AS kind FROM ed
         UNION ALL SELECT seq_id, state, sfx, 'suffix' FROM st WHERE sfx > 0) l JOIN sq USING (seq_id))""",
    ints=["seq_id", "src", "dst"], reals=["x0", "x1", "arc"], texts=["kind"],
)
