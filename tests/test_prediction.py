import numpy as np
import pytest

from seqloom.operators import predict
from seqloom.operators.links import link_symbols


def below(items):
    """Symbol counts under every state, tree by tree."""
    links = link_symbols(items)
    code = {c: j for j, c in enumerate(dict.fromkeys(items))}
    own = np.zeros((len(items) + 1, len(code)))
    for s, targets in enumerate(links["trn"]):
        for t in targets:
            own[s, code[items[t - 1]]] = 1
    total = own.copy()
    for s in range(len(items), 0, -1):
        total[links["sfx"][s]] += total[s]
    return own, total


@pytest.mark.parametrize("kinds", [1, 2, 5, 80])
def test_counts_below_every_state(kinds):
    items = np.random.default_rng(kinds).integers(0, kinds, 80).tolist()
    model, (own, total) = predict.Model(items), below(items)
    for s in range(len(items) + 1):
        stretch = model.codes[model.first[s] : model.last[s]]
        assert np.bincount(stretch, minlength=total.shape[1]).tolist() == total[s].tolist()
        assert sorted(model.goto[s]) == np.flatnonzero(own[s]).tolist()
    for size in (0, 1, 3, 10, 40):
        context = items[20 : 20 + size]
        counts, used = model.predict(context)
        for symbol in model.symbols:
            prob, same = model.share(context, symbol)
            assert same == used and prob == pytest.approx(counts[model.code[symbol]] / counts.sum())
    assert model.share([], "never seen")[0] == pytest.approx(1 / model.predict([])[0].sum())


def test_a_hundred_thousand_distinct_symbols(spark):
    n = 50_000
    rows = [(1, (i,), i) for i in range(n)] + [(2, (i,), n + i) for i in range(n)]
    seqs = spark.createDataFrame(rows, "seq_id long, ord struct<n:int>, item int")
    asked = spark.createDataFrame([(1, 0, [7, 8, 9]), (2, 0, [n + 1])], "seq_id long, ctx_id long, context array<int>")
    got = predict.predict(seqs, asked).groupBy("seq_id").agg({"prob": "sum", "symbol": "count"}).collect()
    assert {(r[0], r["count(symbol)"]) for r in got} == {(1, n), (2, n)}
    assert all(abs(r["sum(prob)"] - 1) < 1e-6 for r in got)
    tests = seqs.where("ord.n < 50").selectExpr("*", "0 AS test_id")
    loss = {r.seq_id: r for r in predict.log_loss(seqs, tests, 2).collect()}
    assert loss.keys() == {1, 2} and all(r.log_loss > 0 for r in loss.values())
