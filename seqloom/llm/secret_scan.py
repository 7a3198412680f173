r"""Secret scans: fixed patterns and a battery of randomness tests, in built-in functions.

Patterns find assignments, access keys and long hexadecimal runs.  Every other run of 20
or more key characters is a candidate: its encoding is inferred from the characters it
uses and its symbols, as numbers of that alphabet, go through three tests of randomness:
chi-squared uniformity over four equal parts of the alphabet, the number of runs above and
below the middle, and serial correlation of neighbours.  The smallest of the three
p-values, times three, is the candidate's.  A weighted step-up procedure over the
candidates of a text, with weights in proportion to their lengths, controls the rate of
random strings wrongly cleared; candidates it does not reject are reported as ``random``.

Spans are code points, end exclusive, of whole matches.  Null text is empty.  Repeated rows,
null ids and extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters or more
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
VALUE = 8  # characters an assigned value has at least
RATE = 0.05  # of false rejections among the rejected
LETTERS_ONLY = 52  # characters below which letters alone tell nothing

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
# (characters allowed, alphabet in value order); the first that fits is the encoding.
ENCODINGS = (
    ("[0-9a-f]+", DIGITS + "abcdef"),
    ("[0-9A-F]+", DIGITS + "ABCDEF"),
    ("[A-Z2-7]+", UPPER + "234567"),
    ("[0-9a-z]+", DIGITS + LOWER),
    ("[0-9A-Z]+", DIGITS + UPPER),
    ("[0-9A-Za-z]+", DIGITS + UPPER + LOWER),
    ("[A-Za-z0-9_-]+", UPPER + LOWER + DIGITS + "-_"),
)
BASE64 = UPPER + LOWER + DIGITS + "+/"

SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: the text between them gives their places."""

    def placed(pieces, hits):
        def step(state, i):
            start = state["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(hits, i))
            span = F.struct(start.alias("start"), end.alias("end"), F.get(hits, i).alias("hit"))
            return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).cast(SPAN).alias("spans"))

        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
        at = F.sequence(F.lit(0), F.size(hits) - 1)
        return F.when(F.size(hits) == 0, F.array().cast(SPAN)).otherwise(F.aggregate(at, first, step, lambda s: s["spans"]))

    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(hits, lambda h: let(pieces, lambda p: placed(p, h)))


def _some(guard: Column, spans: Column) -> Column:
    return F.when(guard, spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> list[Column]:
    """Spans of the three fixed kinds, in the order of ``KINDS``."""
    folded = F.lower(text)
    named = let(folded, lambda t: reduce(or_, [t.contains(k) for k in KEYWORDS]))
    assign = F.filter(matches(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= VALUE)
    return [
        _some(named, assign),
        _some(text.contains("AKIA"), matches(text, ACCESS)),
        _some(text.rlike(HEX), matches(text, HEX)),
    ]


def random_spans(text: Column) -> Column:
    """Candidates that the battery does not reject as random."""

    def tested(spans):
        judged = F.transform(spans, lambda s: F.struct(s.alias("span"), p_value(s["hit"]).alias("p")))
        return let(F.filter(judged, lambda j: j["p"].isNotNull()), _not_rejected)

    return _some(text.rlike(CANDIDATE), let(matches(text, CANDIDATE), tested))


def _not_rejected(judged: Column) -> Column:
    """Step-up over p-values divided by their weights; the rest are the spans returned."""

    def weighted(js):
        size = F.aggregate(js, F.lit(0.0), lambda a, j: a + F.length(j["span"]["hit"]))
        scale = size / F.size(js)
        return F.transform(js, lambda j: F.struct((j["p"] * scale / F.length(j["span"]["hit"])).alias("q"), j["span"].alias("span")))

    def stepped(sorted_js):
        level = F.transform(sorted_js, lambda j, i: F.when(j["q"] <= RATE * (i + 1) / F.size(sorted_js), j["q"]))
        cut = F.coalesce(F.array_max(level), F.lit(-1.0))
        return let(cut, lambda c: F.transform(F.filter(sorted_js, lambda j: j["q"] > c), lambda j: j["span"]))

    kept = let(F.sort_array(weighted(judged)), stepped)
    return F.when(F.size(judged) == 0, F.array().cast(SPAN)).otherwise(kept)


def p_value(token: Column) -> Column:
    """p-value of the token as random symbols; null where it cannot be a key.

    Numbers alone and short tokens of letters alone are no candidates.
    """
    bare = F.rtrim(F.translate(token, "=", " "))
    letters = ~token.rlike("[0-9]")
    numbers = ~token.rlike("[A-Za-z]")
    no_key = numbers | (F.length(bare) < 16) | (letters & (F.length(bare) < LETTERS_ONLY))

    def over(t):
        alphabet = F.lit(BASE64)
        for allowed, symbols in reversed(ENCODINGS):
            alphabet = F.when(t.rlike(f"^{allowed}$"), F.lit(symbols)).otherwise(alphabet)
        return let(alphabet, lambda a: let(_values(t, a), lambda x: _battery(x, F.length(a))))

    return F.when(no_key, F.lit(None).cast("double")).otherwise(let(bare, over))


def _values(token: Column, alphabet: Column) -> Column:
    symbols = F.filter(F.split(token, ""), lambda c: c != "")
    return F.transform(symbols, lambda c: (F.greatest(F.instr(alphabet, c), F.lit(1)) - 1).cast("double"))


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + f(v))


def _battery(x: Column, k: Column) -> Column:
    n = F.size(x).cast("double")
    expected = n / 4
    parts = [_sum(x, lambda v, i=i: F.when(F.floor(v * 4 / k) == i, 1.0).otherwise(0.0)) for i in range(4)]
    chi = sum(((c - expected) * (c - expected) / expected for c in parts), F.lit(0.0))
    spread = 2.0 / 27  # cube-root approximation for three degrees of freedom
    uniform = 1 - normal_cdf((F.pow(chi / 3, F.lit(1.0 / 3)) - (1 - spread)) / spread**0.5)

    above = F.transform(x, lambda v: v * 2 >= k)
    n1 = let(above, lambda a: F.size(F.filter(a, lambda v: v)).cast("double"))
    runs = let(above, lambda a: 1.0 + F.size(F.filter(a, lambda v, i: (i > 0) & (v != F.get(a, F.greatest(i - 1, F.lit(0)))))))
    mean = 2 * n1 * (n - n1) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    in_runs = F.when(var > 0, _two_sided((runs - mean) / F.sqrt(var))).otherwise(0.0)

    centre = _sum(x, lambda v: v) / n
    dev = F.transform(x, lambda v: v - centre)
    square = let(dev, lambda d: _sum(d, lambda v: v * v))
    lagged = let(dev, lambda d: _sum(F.transform(d, lambda v, i: v * F.coalesce(F.get(d, i + 1), F.lit(0.0))), lambda v: v))
    serial = F.when(square > 0, _two_sided(lagged / square * F.sqrt(n))).otherwise(0.0)
    return F.least(F.lit(1.0), 3 * F.least(uniform, in_runs, serial))


def normal_cdf(z: Column) -> Column:
    """Polynomial approximation of the normal distribution, good to seven digits."""

    def tail(a):
        t = 1 / (1 + 0.2316419 * a)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-a * a / 2) * 0.3989422804014327 * poly

    return let(z, lambda v: F.when(v >= 0, 1 - tail(F.abs(v))).otherwise(tail(F.abs(v))))


def _two_sided(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with an array ``out`` of ``start, rank, kind, end`` in the order of the text.

    Random strings inside a span of a fixed kind are not listed again.
    """
    plain = F.coalesce(F.col(text), F.lit(""))

    def ranked(spans, rank):
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), s["end"].alias("end")
            ),
        )

    base = F.concat(*[ranked(s, i) for i, s in enumerate(base_spans(plain))])

    def joined(b):
        fresh = F.filter(
            random_spans(plain), lambda r: ~F.exists(b, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"]))
        )
        return F.sort_array(F.concat(b, ranked(fresh, 3)))

    return docs.withColumn(out, let(base, joined))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by a mark."""

    def step(state, s):
        between = F.substr(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = F.when(s["start"] >= state["at"], F.concat(between, F.lit(mark))).otherwise("")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], fresh).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
