import random

import numpy as np
import pytest

from corpus import awkward, frame, prose
from seqloom.llm import mixing

LABELS = "doc_id long, quality int, toxic int, posteriors int"


def corpus(n=240):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        domain = r.choice(["good", "good", "good", "poor", "toxic"])
        text = prose(i, 60)
        if domain == "poor":
            text = " ".join(w.upper() + "!!" for w in text.split())
        if domain == "toxic":
            text += " " + " ".join(r.choice(["scum", "vermin", "filth"]) for _ in range(5))
        rows.append((i, text))
        labels.append((i, int(domain != "poor"), int(domain == "toxic"), 0))
    return rows, labels


def test_held_out_accuracy_and_targets(spark):
    rows, labels = corpus()
    train = spark.createDataFrame([x for x in labels if x[0] % 3], LABELS)
    got = {r.doc_id: r for r in mixing.rates(frame(spark, rows), train).collect()}
    assert got.keys() == {i for i, _ in rows}
    held_out = [x for x in labels if x[0] % 3 == 0]
    right = 0
    for i, quality, toxic, _ in held_out:
        want = 2 if toxic else 0 if quality else 1
        right += int(np.argmax(got[i].posteriors) == want)
    assert right >= 0.9 * len(held_out)
    totals = np.zeros(3)
    for r in got.values():
        assert r.rate >= 0 and abs(sum(r.posteriors) - 1) < 1e-9 and abs(r.copies - r.rate) < 1
        totals += r.rate * r.tokens * np.array(r.posteriors)
    share = totals / totals.sum()
    assert abs(share[0] - 0.97) < 0.02 and abs(share[1] - 0.03) < 0.02
    assert all(got[i].rate < 0.1 for i, _, toxic, _ in labels if toxic and got[i].posteriors[2] > 0.95)
    assert all(got[i].copies >= 1 for i, quality, toxic, _ in labels if quality and not toxic and max(got[i].posteriors) > 0.99)


def test_rates_solve_the_least_squares_problem(spark):
    rng = np.random.default_rng(1)
    p, tokens = rng.dirichlet([0.3, 0.3, 0.3], 300), rng.integers(1, 400, 300)
    scored = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, posteriors array<double>")
    steps, target = mixing.solve(scored, {"good": 0.5, "poor": 0.3, "toxic": 0.2}, 30_000.0)
    rate = mixing.rates_after(p, steps)
    assert (rate >= 0).all()
    assert np.allclose((rate * tokens) @ p, target, rtol=0.01)


@pytest.mark.parametrize("labelled", [[], [(1, 1, 0, 0)], [(5, None, 0, 0), (None, 1, 0, 0)], [(5, 1, 0, 0), (6, 0, 0, 0), (5, 1, 1, 0)]])
def test_odd_inputs(spark, labelled):
    rows = awkward()
    labels = spark.createDataFrame(labelled, LABELS)
    got = mixing.rates(frame(spark, rows), labels).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i, _ in rows)
    mixed = mixing.mix(frame(spark, rows), labels)
    assert mixed.columns == frame(spark, rows).columns
    copies = {r.doc_id: r.copies for r in got}
    assert sorted(r.doc_id or -1 for r in mixed.collect()) == sorted(i or -1 for i, _ in rows for _ in range(copies[i]))


def test_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0, 0)], LABELS)
    assert mixing.rates(frame(spark, []), labels).count() == 0
    assert mixing.mix(frame(spark, []), labels).count() == 0
