"""Boosted trees against a brute-force learner in plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from panelweave.operators import boosting as B


def slopes(loss: str, y: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    miss = guess - y
    if loss == "squared":
        return miss, np.ones_like(y)
    if loss == "poisson":
        return np.exp(guess) - y, np.exp(guess)
    return miss / np.sqrt(1 + miss**2), 1 / (1 + miss**2) ** 1.5


def best_cut(x, g, h, rows, edges, s: B.Boosting):
    """Every predictor, every edge, every row."""
    found = None
    score = lambda part: g[part].sum() ** 2 / (h[part].sum() + s.penalty)
    for f in range(x.shape[1]):
        for edge in edges[f]:
            low, high = rows[x[rows, f] <= edge], rows[x[rows, f] > edge]
            if min(len(low), len(high)) < s.min_n or not len(low) or not len(high):
                continue
            gain = (score(low) + score(high) - score(rows)) / 2 - s.loss_reduction
            if gain > 0 and (found is None or B._rank(gain) > B._rank(found[0])):
                found = (gain, f, edge, low, high)
    return found


def grow(x, g, h, edges, s: B.Boosting) -> np.ndarray:
    """What one tree adds to each row, and its leaves as (rows, depth)."""
    leaves = [(np.arange(len(x)), 0)]
    cuts = [best_cut(x, g, h, leaves[0][0], edges, s)]
    while True:
        open_ = [i for i, c in enumerate(cuts) if c is not None and leaves[i][1] < s.depth]
        if not open_ or (s.leaves and len(leaves) >= s.leaves):
            break
        i = max(open_, key=lambda i: B._rank(cuts[i][0]))  # for growth by depth the order does not matter
        (_, depth), (_, _, _, low, high) = leaves[i], cuts[i]
        leaves[i], cuts[i] = (low, depth + 1), best_cut(x, g, h, low, edges, s)
        leaves.append((high, depth + 1))
        cuts.append(best_cut(x, g, h, high, edges, s))
    out = np.zeros(len(x))
    for rows, _ in leaves:
        out[rows] = -s.learn_rate * g[rows].sum() / (h[rows].sum() + s.penalty)
    return out


def brute(x, y, edges, s: B.Boosting) -> np.ndarray:
    guess = np.full(len(y), np.log(y.mean()) if s.loss == "poisson" else y.mean())
    for _ in range(s.trees):
        guess = guess + grow(x, *slopes(s.loss, y, guess), edges, s)
    return guess


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(5)
    x = np.column_stack([draw.normal(size=400), draw.integers(0, 6, 400), draw.uniform(size=400), np.ones(400)])
    y = 3 + 2 * (x[:, 0] > 0.3) * x[:, 1] + np.sin(5 * x[:, 2]) + 0.1 * draw.normal(size=400)
    table = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "value double, x array<double>")
    return x, y, table.select("value", array_to_vector("x").alias("features"))


SETTINGS = {
    "by_depth": B.Boosting(6, 0.3, 4, 5, 0.001, 1.0, bins=16),
    "by_leaf": B.Boosting(6, 0.3, 6, 5, 0.0, 0.0, leaves=7, bins=16),
    "large_reduction": B.Boosting(3, 0.3, 4, 20, 5.0, 2.0, bins=8),
    "huber": B.Boosting(4, 0.5, 3, 5, 0.0, 1.0, leaves=5, bins=16, loss="pseudo_huber"),
    "poisson": B.Boosting(4, 0.5, 3, 5, 0.0, 1.0, bins=16, loss="poisson"),
}


@pytest.mark.parametrize("name", SETTINGS)
def test_equals_brute_force(spark, rows, name):
    x, y, table = rows
    s = SETTINGS[name]
    known = table.select("value", vector_to_array("features").alias("x"))
    edges = B.quantile_edges(known, x.shape[1], s.bins)
    assert edges[3] == [] and edges[1] == [0.0, 1.0, 2.0, 3.0, 4.0]
    want = brute(x, y, edges, s)
    got = np.array([r["prediction"] for r in s.fit(table).transform(table).collect()])
    assert np.abs(got - want).max() < 1e-8


def test_leaf_limit_and_order(spark, rows):
    _, _, table = rows
    model = B.Boosting(2, 0.3, 8, 5, leaves=6, bins=16).fit(table)
    assert [sum(f < 0 for f in t.feature) for t in model.trees] == [6, 6]


def test_stored_trees_predict_the_same(spark, rows, tmp_path):
    _, _, table = rows
    model = SETTINGS["by_depth"].fit(table)
    model.save(spark, str(tmp_path))
    again = B.BoostedTrees.load(spark, str(tmp_path))
    both = again.transform(model.transform(table).withColumnRenamed("prediction", "first"))
    assert both.filter(F.abs(F.col("first") - F.col("prediction")) > 1e-12).count() == 0


def test_nothing_to_learn(spark):
    table = spark.createDataFrame([(2.0, [1.0])] * 8, "value double, x array<double>").select("value", array_to_vector("x").alias("features"))
    model = B.Boosting(5, bins=4).fit(table)
    assert model.trees == [] and {r["prediction"] for r in model.transform(table).collect()} == {2.0}
    with pytest.raises(ValueError, match="no rows"):
        B.Boosting(1).fit(table.limit(0))


def test_rows_lie_in_blocks_and_levels_go_in_passes(spark, rows, monkeypatch):
    x, y, table = rows
    s = SETTINGS["by_depth"]
    binned = s.prepare(table)
    assert binned.blocks.count() < len(y) / 4  # what a level reads and binds: blocks, not rows or cells
    monkeypatch.setattr(B, "CELLS_HELD", 2 * binned.n_features * binned.width)  # two leaves a pass
    got = np.array([r["prediction"] for r in s.fit_binned(binned).transform(table).collect()])
    assert np.abs(got - brute(x, y, binned.edges, s)).max() < 1e-8


def test_edges_are_values_at_ranks(spark, monkeypatch):
    monkeypatch.setattr(B, "QUANTILE_ROWS", 300)
    draw = np.random.default_rng(2).normal(size=1000)
    known = spark.createDataFrame([([float(v), float(int(v))],) for v in draw], "x array<double>").coalesce(1)
    line = np.sort(draw)
    want = sorted({float(line[int(np.ceil(1000 * i / 8)) - 1]) for i in range(1, 8)})
    edges = B.quantile_edges(known, None, 8)
    assert edges[0] == want and set(edges[1]) <= {float(int(v)) for v in draw}


def test_tuning_bins_a_slice_once(spark, monkeypatch):
    import datetime

    from panelweave.operators import global_ml as G

    days = [datetime.date(2000 + i // 12, i % 12 + 1, 1) for i in range(30)]
    panel = spark.createDataFrame([(k, d, float(i * (k == "a") + i % 12)) for k in ("a", "b") for i, d in enumerate(days)], "id string, date date, value double")
    table = G.feature_table(panel, G.calendar_set()).cache()
    plan = spark.createDataFrame([(1, days[0], days[19], days[20], days[24])], "slice_id long, train_start date, train_end date, test_start date, test_end date")
    calls, prepare = [], B.Boosting.prepare
    monkeypatch.setattr(B.Boosting, "prepare", lambda self, rows: calls.append(1) or prepare(self, rows))
    found = G.tune_grid(table, plan, G.calendar_set(), ((1, 0.1), (2, 0.1)), trees=1).collect()
    assert len(calls) == 1 and len(found) == 2 and all(r["rmse"] > 0 for r in found)


def test_first_tree_is_shared_and_points_are_judged_together(spark):
    """A shallower first tree is the top of a deeper one, whatever the rate; blocks give the errors of the rows."""
    from panelweave.operators import global_ml as G

    rows = spark.createDataFrame([(float((i * 7) % 23) + (i % 4) * 3.0, Vectors.dense([i % 11, (i * 5) % 17])) for i in range(400)], ["value", "features"])
    test = spark.createDataFrame([(float(i % 19), Vectors.dense([i % 13 - 0.5, (i * 3) % 19])) for i in range(90)], ["value", "features"])
    deep = G.leaf_boosting(1, 0.1, 4)
    binned = deep.prepare(rows)
    first = deep.first_cuts(binned)
    models = [G.leaf_boosting(3, rate, depth).fit_binned(binned, first) for depth, rate in ((1, 0.5), (2, 0.1), (4, 0.3))]
    for (depth, rate), model in zip(((1, 0.5), (2, 0.1), (4, 0.3)), models):
        assert model.trees == G.leaf_boosting(3, rate, depth).fit_binned(binned).trees
    sums = B.block_errors(models, binned.pack(test), binned).groupBy("model").agg(
        F.sum("absolute").alias("a"), F.sum("squared").alias("s"), F.sum("n").alias("n")
    )
    found = {r["model"]: (r["a"], r["s"], r["n"]) for r in sums.collect()}
    for i, model in enumerate(models):
        miss = [r["value"] - r["prediction"] for r in model.transform(test).collect()]
        assert found[i] == pytest.approx((sum(map(abs, miss)), sum(m * m for m in miss), 90))
    nothing = {r["model"]: r["n"] for r in B.block_errors(models, binned.pack(test.limit(0)), binned).collect()}
    assert nothing == {0: 0, 1: 0, 2: 0}
