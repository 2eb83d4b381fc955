"""Boosted trees and sliding order statistics against their definitions."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.frames import walk
from tidebars.operators import select as sel
from tidebars.operators import trees as bt
from tidebars.operators.order import WindowRanks


def plain_tree(x, r, how, bins, node=1, rows=None, depth=0):
    """Nodes and additions by trying every split of every node."""
    rows = list(range(len(r))) if rows is None else rows
    g, n = sum(int(r[i]) for i in rows), len(rows)
    best = (0.0, None, None)
    if depth < how.depth:
        for f in range(x.shape[1]):
            for b in range(bins - 1):
                left = [i for i in rows if x[i, f] <= b]
                if 0 < len(left) < n:
                    gl = sum(int(r[i]) for i in left)
                    gr, nr = g - gl, n - len(left)
                    gain = gl * gl / (len(left) + how.l2) + gr * gr / (nr + how.l2) - g * g / (n + how.l2)
                    if gain > best[0]:
                        best = (gain, f, b)
    gain, f, b = best
    if f is None:
        value = int(np.floor(how.rate * g / (n + how.l2) + 0.5))
        return [(node, None, None, n, value)], dict.fromkeys(rows, value)
    halves = [[i for i in rows if x[i, f] <= b], [i for i in rows if x[i, f] > b]]
    out, add = [(node, f, b, n, None)], {}
    for k, half in enumerate(halves):
        nodes, more = plain_tree(x, r, how, bins, 2 * node + k, half, depth + 1)
        out += nodes
        add |= more
    return out, add


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 40), st.integers(1, 4), st.integers(1, 3))
def test_one_tree_is_the_best_of_all_splits(seed, n, p, depth):
    rng = np.random.default_rng(seed)
    x, r, how = rng.integers(0, 5, (n, p)).astype("u1"), rng.integers(-(2**20), 2**20, n), bt.Boosting(1, depth)
    nodes, add = bt.grow(x, r, how, 5)
    want, plain = plain_tree(x, r, how, 5)
    assert sorted((k, f, b, c, v) for k, f, b, _, c, v in nodes) == sorted(want, key=lambda t: t[0])
    assert add.tolist() == [plain[i] for i in range(n)]


def test_ensemble_predicts_what_was_fitted_in_any_order():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 32, (500, 6)).astype("u1")
    y = (x[:, 2].astype("i8") * 1000 + rng.integers(0, 300, 500)) * 100
    how = bt.Boosting(30, 4)
    nodes = bt.fit(x, y, how)
    model = bt.Ensemble.from_bytes(bt.Ensemble.of(nodes).to_bytes())
    assert np.abs(model.predict(x) - y).mean() < 0.05 * np.abs(y - y.mean()).mean()
    mixed = rng.permutation(500)
    pd.testing.assert_frame_equal(nodes, bt.fit(x[mixed], y[mixed], how))
    share = bt.importance(nodes, 6)
    assert share.argmax() == 2 and share.sum() == pytest.approx(1)
    # Prediction by walking the table.
    by = {(t, k): (f, b, v) for t, k, f, b, v in nodes[["tree", "node", "feature", "bin", "value"]].itertuples(index=False)}
    for i in range(20):
        total = 0
        for t in range(-1, 30):
            k = 1
            while (t, k) in by and not pd.isna(by[t, k][0]):
                f, b, _ = by[t, k]
                k = 2 * k + int(x[i, int(f)] > b)
            total += by[t, k][2] if (t, k) in by else 0
        assert total == model.predict(x[i : i + 1])[0]


def test_node_table_scores_rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(400, 3)), columns=["x0", "x1", "x2"]).assign(close=lambda d: 3 * d["x1"] + d["x2"])
    nodes = sel.tree_nodes(spark.createDataFrame(pdf), trees=20, depth=3).toPandas()
    by = {(t, k): r for t, k, *r in nodes[["tree", "node", "feature", "threshold", "value"]].itertuples(index=False)}
    said = []
    for row in pdf.to_dict("records"):
        total = 0.0
        for t in range(-1, 20):
            k = 1
            while by[t, k][0] is not None:
                k = 2 * k + int(row[by[t, k][0]] > by[t, k][1])
            total += by[t, k][2]
        said.append(total)
    assert np.mean((np.array(said) - pdf["close"]) ** 2) < 0.1 * pdf["close"].var()
    shares = sel.tree_importance(spark.createDataFrame(pdf), trees=20, depth=3).toPandas()
    assert shares["importance"].sum() == pytest.approx(1) and shares.set_index("feature")["importance"].idxmax() == "x1"


def test_elimination_scores_every_test_row(spark):
    """The scores of each fold and round against fits of the same rows outside Spark."""
    rng = np.random.default_rng(2)
    pdf = walk(240).assign(noise=rng.normal(size=240), signal=lambda d: d["close"] * 2)
    df = spark.createDataFrame(pdf)
    rounds = {(r["fold"], r["n_features"]): r for r in sel.rfecv_rounds(df, trees=10, depth=2, min_features=2).collect()}
    assert sorted({n for _, n in rounds}) == [2, 4, 6] and {k for k, _ in rounds} == {1, 2, 3, 4, 5, 6}
    assert all(r["train_rows"] == 40 * r["fold"] and r["test_rows"] == (40 if r["fold"] < 6 else 0) for r in rounds.values())
    cols = sel.features_of(df, "close")
    how = bt.binning(bt.numbers(df, cols, "close"), cols)
    x, y = how.bins([pdf[n].to_numpy(float) for n in cols]), np.rint(pdf["close"].to_numpy() / how.unit).astype("i8")
    for k in range(1, 6):
        at = list(range(len(cols)))
        for n in (6, 4, 2):
            assert set(rounds[k, n]["features"]) == {cols[i] for i in at}
            nodes = bt.fit(x[: 40 * k, at], y[: 40 * k], bt.Boosting(10, 2))
            miss = (bt.Ensemble.of(nodes).predict(x[40 * k : 40 * k + 40][:, at]) - y[40 * k : 40 * k + 40]) * how.unit
            assert rounds[k, n]["score"] == pytest.approx(-np.mean(miss**2))
            worth = bt.importance(nodes, len(at))
            assert rounds[k, n]["strongest"] == cols[at[worth.argmax()]]
            at = [at[i] for i in sorted(sorted(range(len(at)), key=lambda i: (worth[i], -i))[2:])]
    chosen, report = sel.rfecv(df, trees=10, depth=2, min_features=2)
    best = max(report.collect(), key=lambda r: r["score"])["n_features"]
    assert len(chosen) == best and chosen == rounds[6, best]["features"]


def test_nothing_to_learn(spark):
    flat = walk(60).assign(open=1.0, high=1.0, low=1.0, close=1.0, volume=5)
    chosen, report = sel.rfecv(spark.createDataFrame(flat), trees=3, min_features=2)
    assert len(chosen) in (2, 4) and all(r["score"] == pytest.approx(0, abs=1e-12) for r in report.collect())
    assert {r["importance"] for r in sel.tree_importance(spark.createDataFrame(flat), trees=3).collect()} == {0.0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.data())
def test_ranks_within_windows(values, data):
    x = np.array(values, float)
    width = data.draw(st.integers(1, len(x)))
    order = WindowRanks(x)
    first = np.arange(len(x) - width + 1)
    k = data.draw(st.integers(0, width - 1))
    got = order.kth(first, first + width, np.full(len(first), k))
    assert got.tolist() == [sorted(x[a : a + width])[k] for a in first]
    now = order.ranks[first + width - 1]
    assert order.below(first, first + width, now).tolist() == [int((x[a : a + width] < x[a + width - 1]).sum()) for a in first]
    assert order.below(first, first + width, now + 1).tolist() == [int((x[a : a + width] <= x[a + width - 1]).sum()) for a in first]
