"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import quality

_SPACE = r"[\x20\x09-\x0D]+"


def _stop_counts() -> str:
    counts = []
    for listed in quality.STOP_WORDS.values():
        names = ", ".join(f"'{w}'" for w in listed.split())
        counts.append(f"len(list_filter(w, lambda x: list_contains([{names}], x)))")
    return f"greatest({', '.join(counts)})"


def _rules() -> str:
    tests = [f"{r.measure} >= {r.low}" for r in quality.RULES if r.low is not None]
    return " AND ".join(tests + [f"{r.measure} <= {r.high}" for r in quality.RULES if r.high is not None])


QUALITY = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS ls
  FROM documents),
windows AS (
  SELECT row_id, i, array_to_string(w[i : i + 7], ' ') AS k
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 6)) AS i FROM parts)),
twice AS (
  SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, k) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT row_id, sum(least(8, coalesce(following - i, 8))) AS n FROM (
    SELECT row_id, i, lead(i) OVER (PARTITION BY row_id ORDER BY i) AS following FROM twice) GROUP BY row_id),
counted AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines, {_stop_counts()} AS stops,
    len(list_filter(ls, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS dots,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS bullets
  FROM parts LEFT JOIN repeats r USING (row_id)),
measured AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
    stops / greatest(n_words, 1) AS stop_word_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
    dots / greatest(n_lines, 1) AS ellipsis_line_ratio, bullets / greatest(n_lines, 1) AS bullet_line_ratio,
    n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_rules()} AS kept
FROM measured
"""

_UNESCAPE = r"regexp_replace({0}, '\\([\\/#])', '\1', 'g')"
_ESCAPE = r"replace(replace(replace(t, '\', '\\'), '</turn>', '<\/turn>'), '### ', '\### ')"

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (
  SELECT *, CASE WHEN contains(t, '</turn>') OR contains(t, '### ') OR {_UNESCAPE.format("t")} <> t
    THEN {_ESCAPE} ELSE t END AS body FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || r || ': ' || body || '</turn>') + 1)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

SUBSTRINGS = rf"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs)),
later AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, (SELECT unnest(range(20)) AS j)),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t
  FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

SUFFIXES = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS k
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM docs)),
firsts AS (SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k HAVING count(*) > 1),
later AS (SELECT doc_id, i FROM windows JOIN firsts USING (k) WHERE first_id < doc_id),
islands AS (
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (
    SELECT doc_id, i, (i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) > 50)::INT AS opens FROM later)),
spans AS (SELECT doc_id, island, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY ALL),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
parts AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head
  FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM docs LEFT JOIN parts USING (doc_id)
"""

LINES = r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
placed AS (SELECT row_id, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM placed),
gone AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row_id) >= 10),
kept AS (
  SELECT row_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t
  FROM keyed ANTI JOIN gone USING (k) GROUP BY row_id)
SELECT doc_id, len(ls) AS n_lines, len(ls) - coalesce(n, 0) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (row_id)
"""


def _clustering(k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64) -> str:
    nearest = f"""
  SELECT row_id, vec_id, x.v AS v, min(list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) ** 2))::BIGINT * {k} + c) AS m
  FROM kept x, c{{0}} y GROUP BY ALL"""
    parts = [
        f"""
kept AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {width}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k}),
a0 AS ({nearest.format(0)})"""
    ]
    for r in range(1, rounds + 1):
        parts.append(f"""
s{r} AS (
  SELECT m % {k} AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n
  FROM a{r - 1}, (SELECT unnest(range(1, {width + 1})) AS i) GROUP BY ALL),
n{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM s{r} GROUP BY c),
c{r} AS (SELECT c, coalesce(w, v) AS v FROM c{r - 1} LEFT JOIN n{r} USING (c)),
a{r} AS ({nearest.format(r)})""")
    last = f"""
SELECT vec_id, (m % {k})::INTEGER AS cluster, m // {k} AS distance,
  sum(m // {k}) OVER (PARTITION BY m % {k})::BIGINT AS cluster_inertia, sum(m // {k}) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(y.v, lambda c: c::VARCHAR), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} y ON c = m % {k}"""
    return "WITH" + ",".join(parts) + last


CLUSTERING = _clustering()
