"""Small awkward inputs and plain Python versions of the operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slice int, rank string, quality int"
BLANKS = re.compile("[\x20\x09-\x0d]+")

VOCABULARY = "the of and red blue stone river über naïve 漢字 x1 well-known tree, house. 😀 a b c".split()


def words(text):
    return [w for w in BLANKS.split(text or "") if w]


def prose(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(r.choice(VOCABULARY) + ("" if r.random() < 0.3 else str(r.randrange(400))))
        out.append(r.choice([" ", " ", " ", "\n", "  ", "\t"]))
    return "".join(out)


def awkward():
    """Rows ``doc_id, text``: nulls, empty and long texts, ties, repeated rows, shared passages."""
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [
        (1, "plain words here"),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (None, "a text without an id " + passage),
        (None, "a text without an id " + passage),
        (5, prose(1, 300)),
        (6, prose(1, 300)),
        (7, prose(1, 300) + " and a tail"),
        (8, "x" + prose(1, 300)),
        (9, prose(2, 5) + passage + prose(3, 30)),
        (10, prose(4, 40) + passage),
        (11, passage + " " + passage),
        (12, "word " * 400),
        (13, "a" * 500),
        (14, "same line\nsame line\nother\n" * 20),
        (15, prose(9, 4000)),
        (15, prose(9, 4000)),
        (16, "no-blanks-" * 60),
        (17, "é" * 120 + "漢" * 60),
        (18, "é" * 121),
        (20, "The ...\n- bullet\n* other ###$$%%&&"),
    ]
    return rows


def frame(spark, rows):
    """The rows with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", "src0", None if t is None else len(t), 7, "r", 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.root(a)] = self.root(b)
