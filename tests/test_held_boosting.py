"""Trees grown in one task are those of a job for each level, and the registered queries ask for the full ensembles."""

from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from panelweave.operators import boosting as B
from panelweave.operators import global_ml as G
from panelweave.operators import held_boosting as H
from panelweave.plans import queries_models as Q
from tests.conftest import month

SETTINGS = {
    "by_depth": B.Boosting(4, 0.3, 6, 5, 0.001, 1.0, bins=32),
    "by_leaf": B.Boosting(4, 0.3, 7, 5, 0.0, 0.0, leaves=12, bins=32),
    "huber": B.Boosting(3, 0.5, 4, 5, 0.0, 1.0, leaves=6, bins=16, loss="pseudo_huber"),
    "poisson": B.Boosting(3, 0.5, 3, 5, 0.0, 1.0, bins=16, loss="poisson"),
}


@pytest.fixture(scope="module")
def table(spark):
    """Predictors of few values side by side, some wanting, between wide ones."""
    draw = np.random.default_rng(8)
    day = draw.integers(0, 48, 700)
    x = np.column_stack([draw.normal(size=700), day % 12, day // 12, day % 12 == 3, np.ones(700), draw.uniform(size=700), draw.integers(0, 3, 700)])
    x[draw.uniform(size=700) < 0.05, 5] = np.nan
    y = 4 + 2 * (x[:, 0] > 0.2) * (day % 12) + day / 10 + draw.normal(size=700)
    rows = [(None if i % 97 == 0 else float(abs(b)), a.tolist()) for i, (b, a) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "value double, x array<double>").select("value", array_to_vector("x").alias("features")).repartition(3)


@pytest.mark.parametrize("few_rows", (H.FEW_ROWS, 0))
@pytest.mark.parametrize("name", SETTINGS)
def test_one_task_grows_the_same_trees(table, monkeypatch, name, few_rows):
    monkeypatch.setattr(H, "FEW_ROWS", few_rows)
    monkeypatch.setattr(H, "SUMMED_AT_ONCE", 100)
    s = SETTINGS[name]
    binned = s.prepare(table)
    assert binned.rows == 700 and s.in_one_task(binned)
    alone, by_level = s._held(binned), s._by_level(binned)
    assert len(alone) == len(by_level) == s.trees

    def leaves(tree: B.Tree) -> list:
        """Every path from the root with what its leaf is worth."""
        def down(node: int, path: tuple) -> list:
            if tree.feature[node] < 0:
                return [(path, pytest.approx(tree.value[node], rel=1e-9, abs=1e-12))]
            step = tree.feature[node], int(tree.cut[node])
            return down(tree.left[node], (*path, (*step, 0))) + down(tree.right[node], (*path, (*step, 1)))

        return down(0, ())

    for a, b in zip(alone, by_level):
        assert [p for p, _ in leaves(a)] == [p for p, _ in leaves(b)]
        assert [v.expected for _, v in leaves(a)] == [v for _, v in leaves(b)]


def test_patterns_are_lossless():
    """A column of patterns gives every predictor's own sums back."""
    draw = np.random.default_rng(3)
    date = draw.integers(0, 40, 900)
    bins = np.column_stack([date % 12, date // 12, date % 2, draw.integers(0, 300, 900), draw.integers(0, 5, 900), np.zeros(900, int)]).astype(np.uint16)
    widths, g = [12, 4, 2, 300, 5, 1], draw.normal(size=900)
    columns = H._Columns(bins, widths)
    assert len(columns.codes) == 3 and columns.tables[0].shape == (3, 40)
    for rows in (None, np.arange(0, 900, 3)):
        n, total = columns.by_bin(columns.sums(rows, [g]))
        some = slice(None) if rows is None else rows
        for f, width in enumerate(widths):
            assert (n[f, :width] == np.bincount(bins[some, f], minlength=width)).all() and not n[f, width:].any()
            assert np.allclose(total[f, :width], np.bincount(bins[some, f], g[some], width))
    for f, cut in ((0, 5), (2, 0), (3, 140), (4, 2)):
        rows = np.arange(5, 900, 2)
        assert (columns.low_side(f, cut, rows) == (bins[rows, f] <= cut)).all()


def test_more_rows_than_a_task_holds_go_by_level(table, monkeypatch):
    s = SETTINGS["by_leaf"]
    binned = s.prepare(table)
    monkeypatch.setattr(B, "TASK_BYTES", 1000)
    assert not s.in_one_task(binned)
    levels = []
    monkeypatch.setattr(B.Boosting, "_by_level", lambda self, binned, first=None: levels.append(1) or [])
    s.fit_binned(binned)
    assert levels == [1]


def test_many_nodes_forecast_as_a_forest(make_panel, monkeypatch):
    draw = np.random.default_rng(1)
    train = make_panel({k: 1000 * draw.normal(size=60) for k in "abc"})
    spec = G.hybrid_set(12)
    table = G.feature_table(train, spec).cache()
    few = G.fit_global(table, spec, G.gradient_boosting(5, 0.3, 4), "m")
    monkeypatch.setattr(G, "NODES_IN_PLAN", 10)
    many = G.fit_global(table, spec, G.gradient_boosting(5, 0.3, 4), "m")
    assert isinstance(many.regressor, G.Forest) and not isinstance(few.regressor, G.Forest)
    ahead = [{(r.id, r.step): r.prediction for r in G.recursive_forecast(m, train, 4).collect()} for m in (few, many)]
    assert len(ahead[0]) == 12 and ahead[0] == pytest.approx(ahead[1])


# --- what the queries ask for ---------------------------------------------------


@pytest.fixture
def asked(spark, make_panel, monkeypatch):
    """The ensembles that a query asks for on a small panel; one tree of each is grown."""
    draw = np.random.default_rng(6)
    panel = make_panel({f"s{i}": 1000 * (5 + i) + 100 * np.sin(np.arange(72) / 2) + 50 * draw.normal(size=72) for i in range(4)})
    train, test = panel.filter(panel["date"] < month(60)), panel.filter(panel["date"] >= month(60))
    monkeypatch.setattr(Q, "_stored_train", lambda *_: (train, test))
    found, fit = [], B.Boosting.fit_binned
    monkeypatch.setattr(B.Boosting, "fit_binned", lambda self, *a: found.append(self) or fit(dataclasses.replace(self, trees=1), *a))

    def run(name: str):
        return getattr(Q, name)(spark, "").collect(), found

    return run


def test_fc_gbt_asks_for_the_full_ensembles(asked):
    rows, found = asked("fc_gbt")
    assert found == [B.Boosting(500, 0.05, 8, 5, 0.001, 1.0)] * 3
    assert {r.model_id for r in rows} == {"gbt_lag", "gbt_calendar", "gbt_hybrid"}


def test_fc_gbt_leaf_asks_for_the_full_ensembles(asked):
    rows, found = asked("fc_gbt_leaf")
    assert found == [B.Boosting(500, 0.05, 6, 5, penalty=0.0, leaves=31)] * 3
    assert {r.model_id for r in rows} == {"gbt_leaf_lag", "gbt_leaf_calendar", "gbt_leaf_hybrid"}


def test_fc_residual_boost_asks_for_the_full_ensembles(asked):
    rows, found = asked("fc_residual_boost")
    assert found == [B.Boosting(500, 0.05, 6, 5, penalty=0.0, leaves=31)] * 2
    assert {r.model_id for r in rows} == {"piecewise_boosted", "autoregression_boosted"}


def test_tune_grid_asks_for_every_point(asked):
    rows, found = asked("tune_grid")
    slices = {r.slice_id for r in rows}
    assert len(slices) > 1 and len(rows) == len(found) == 6 * len(slices)
    assert {(b.depth, b.learn_rate) for b in found} == {(r.tree_depth, r.learn_rate) for r in rows} == set(G.TUNING_GRID)
    assert {b.trees for b in found} == {300} and all(r.rmse > 0 for r in rows)


def test_finalize_and_fit_asks_for_the_full_ensemble(asked):
    rows, found = asked("finalize_and_fit")
    assert rows and len(found) % 6 == 1 and {b.trees for b in found} == {300}
    assert (found[-1].depth, found[-1].learn_rate) in G.TUNING_GRID


def test_tune_halving_asks_for_the_whole_box_and_all_trees(asked):
    rows, found = asked("tune_halving")
    points = set(G.space_filling(6))
    assert {(r.tree_depth, r.learn_rate) for r in rows if r["round"] == 1} == points == {(b.depth, b.learn_rate) for b in found if b.trees == 100}
    assert {r.trees for r in rows} == {100, 300} == {b.trees for b in found} and max(d for d, _ in points) > 6
    assert len({b.depth for b in found if b.trees == 300}) == 2
