"""Quality rules: a threshold table compiled into one projection, without user functions.

``measures`` derives counts and ratios of a text from built-in functions only, and
``verdict`` turns the table of rules into one boolean expression over them.  Texts are
read whole, every row is judged alone and nothing shuffles.

Null text counts as a text without words.  Null ids, repeated rows and extra columns are
kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, total, words

WINDOW = 8  # words of a repeated window
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

# Common words of the languages served; a text is measured by the language it fits best.
STOP_WORDS = {
    "en": "the of and to in is that for was with it as on be at by this are or an from a",
    "de": "der die das und in zu den ist von mit des im ein eine einer nicht auf für sich",
    "fr": "le la les de des et un une en est que qui pour dans par sur pas au avec",
    "es": "el la los las de del y en un una que por con para es se su no al",
}


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; an open side is None."""

    measure: str
    low: float | None = None
    high: float | None = None


# The last word on a text that passes the base rules.  Limits are wide: each one marks a
# text as junk on its own, so an ordinary text has to lie far inside all of them.
RULES = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbols_per_word", None, 0.5),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.6),
    Rule("ellipsis_line_ratio", None, 0.7),
    Rule("bullet_line_ratio", None, 0.95),
)

MIN_WORDS = 20
MAX_REPEATED = 30  # percent of the words


def measures(text: Column) -> Column:
    """Struct of all counts and ratios of one text."""
    plain = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda s: F.length(F.translate(s, BLANKS, "")) > 0)
    return let(words(text), lambda w: let(lines, lambda ls: _measures(plain, w, ls)))


def _measures(plain: Column, w: Column, lines: Column) -> Column:
    n, n_lines = F.size(w).cast("long"), F.size(lines).cast("long")
    word_chars = F.length(F.translate(plain, BLANKS, "")).cast("long")
    n_symbols = (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long")
    n_dup_lines = n_lines - F.size(F.array_distinct(lines))
    per_word, per_line = F.greatest(n, F.lit(1)), F.greatest(n_lines, F.lit(1))
    return F.struct(
        n.alias("n_words"),
        word_chars.alias("word_chars"),
        n_symbols.alias("n_symbols"),
        n_dup_lines.alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        n_lines.alias("n_lines"),
        (word_chars / per_word).alias("mean_word_chars"),
        (n_symbols / per_word).alias("symbols_per_word"),
        (_stop_words(w) / per_word).alias("stop_word_ratio"),
        (n_dup_lines / per_line).alias("dup_line_ratio"),
        (_count(lines, lambda s: s.endswith("...") | s.endswith("…")) / per_line).alias("ellipsis_line_ratio"),
        (_count(lines, lambda s: s.rlike(r"^\s*[-*•]")) / per_line).alias("bullet_line_ratio"),
    )


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def _stop_words(w: Column) -> Column:
    """The count in the language with most of them."""
    return F.greatest(*[_count(w, lambda x: x.isin(listed.split())) for listed in STOP_WORDS.values()])


def repeated_words(w: Column) -> Column:
    """Words in windows of eight words that the text has twice or more.

    Hashes of the windows tell the many texts without any repeat; the others compare the
    windows themselves, sorted so that equal ones are neighbours.
    """
    at = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    unique = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return (
        F.when(F.size(w) < WINDOW, F.lit(0))
        .when(unique, F.lit(0))
        .otherwise(_covered(w, at))
        .cast("long")
    )


def _covered(w: Column, at: Column) -> Column:
    windows = F.sort_array(
        F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("k"), i.alias("i")))
    )

    def same(s, x, j):
        return F.coalesce(F.get(s, j)["k"] == x["k"], F.lit(False))

    def twice(s):
        return F.filter(s, lambda x, j: (j > 0) & same(s, x, F.greatest(j - 1, F.lit(0))) | same(s, x, j + 1))

    starts = let(windows, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    gaps = let(
        starts,
        lambda p: F.transform(p, lambda v, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - v, F.lit(WINDOW)))),
    )
    return total(gaps)


def verdict(rules, m: Column) -> Column:
    """All rules of the table as one boolean expression."""
    bounds = [m[r.measure] >= r.low for r in rules if r.low is not None]
    bounds += [m[r.measure] <= r.high for r in rules if r.high is not None]
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def judge(docs: DataFrame, rules=RULES, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out``: all measures, ``base_failed`` and ``kept``."""

    def judged(m):
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])
        return m.withField("base_failed", failed).withField("kept", ~failed & verdict(rules, m))

    return docs.withColumn(out, let(measures(F.col(text)), judged))  # bound, so a filter on it measures once
