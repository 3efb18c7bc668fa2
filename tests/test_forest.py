"""Random forests against a brute-force learner in plain numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelweave.operators import forest as R
from panelweave.operators import global_ml as G
from panelweave.operators.boosting import BLOCK, Binned, BoostedTrees, Tree, _packed

N = 700  # more than a block


@pytest.fixture(scope="module")
def table():
    draw = np.random.default_rng(3)
    x = np.column_stack([draw.integers(0, 4, N), draw.random(N), draw.normal(size=N), draw.integers(0, 2, N), draw.random(N)]).astype(float)
    return x, 3 * x[:, 0] + np.sin(6 * x[:, 1]) + x[:, 3] * x[:, 2] + draw.normal(size=N) / 5


@pytest.fixture(scope="module")
def rows(spark, table):
    x, y = table
    df = spark.createDataFrame([(i, float(v), r.tolist()) for i, (r, v) in enumerate(zip(x, y))], "i int, value double, x array<double>")
    return df.coalesce(1).sortWithinPartitions("i").withColumn("features", array_to_vector("x"))


def brute(x, y, edges, s: R.RandomForest) -> np.ndarray:
    """The mean of trees that look at every edge of the predictors drawn, with every row as often as it was drawn."""
    total = np.zeros(len(y))
    for number in range(s.trees):
        n = R._draws(np.arange(len(y), dtype=np.uint64), number, s.seed).astype(float)
        leaves = [np.arange(len(y))]
        for level in range(s.depth):
            open_ = [rows for rows in leaves if n[rows].sum() >= 2 * s.min_n]
            drawn, ahead = s._predictors(number, level, len(open_), x.shape[1]), []
            closed = [rows for rows in leaves if n[rows].sum() < 2 * s.min_n]
            score = lambda part: (n[part] * y[part]).sum() ** 2 / n[part].sum()
            for rows, own in zip(open_, drawn):
                best = None
                for f in own:
                    for edge in edges[f]:
                        low, high = rows[x[rows, f] <= edge], rows[x[rows, f] > edge]
                        if min(n[low].sum(), n[high].sum()) >= s.min_n:
                            gain = score(low) + score(high) - score(rows)
                            if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                                best = gain, low, high
                if best:
                    ahead += best[1:]
                else:
                    total[rows] += (n[rows] * y[rows]).sum() / n[rows].sum()
            for part in closed:
                total[part] += (n[part] * y[part]).sum() / n[part].sum()
            leaves = ahead
        for part in leaves:
            total[part] += (n[part] * y[part]).sum() / n[part].sum()
    return total / s.trees


def test_forest_equals_brute_force(rows, table):
    s = R.RandomForest(4, 6, 3, bins=16, seed=11)
    model = s.fit(rows)
    got = [r["prediction"] for r in model.transform(rows).orderBy("i").collect()]
    assert got == pytest.approx(brute(*table, s.prepare(rows).edges, s))
    assert len({t.feature[0] for t in model.trees}) > 1 and min(len(t.feature) for t in model.trees) > 7


def test_draws_are_poisson_and_belong_to_row_and_tree():
    rows = np.arange(200_000, dtype=np.uint64)
    a, b = (R._draws(rows, number, 5).astype(int) for number in (0, 1))
    share = np.bincount(a, minlength=8)[:4] / len(a)
    assert share == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.005)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01 and abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.01
    assert (R._draws(rows[1000:1010], 0, 5) == a[1000:1010]).all()


def test_predictors_drawn_are_a_third():
    drawn = R.RandomForest(seed=1)._predictors(0, 3, 400, 10)
    assert drawn.shape == (400, 4) and (np.diff(drawn, axis=1) > 0).all() and len(np.unique(drawn)) == 10


def test_sums_do_not_depend_on_what_a_task_holds(monkeypatch):
    """Few rows or few leaves at a time, the same sums: what a task holds is bounded."""
    draw = np.random.default_rng(0)
    bins, value = draw.integers(0, 8, (4 * BLOCK, 6)).astype("u1"), draw.random(4 * BLOCK)
    batches = []
    for i in range(4):
        part = slice(i * BLOCK, (i + 1) * BLOCK)
        columns = [_packed(value[part], [BLOCK]), _packed(bins[part], [BLOCK]), pa.array([i])]
        batches.append(pa.RecordBatch.from_arrays(columns, names=["value", "bins", "draw"]))
    tree = Tree()
    leaves = [tree.add()]
    for level in range(7):
        for leaf in leaves:
            tree.feature[leaf], tree.cut[leaf], tree.left[leaf], tree.right[leaf] = level % 6, 3, tree.add(), tree.add()
        leaves = [child for leaf in leaves for child in (tree.left[leaf], tree.right[leaf])]
    jobs = [R._Open(0, tree, leaves, R.RandomForest()._predictors(0, 7, len(leaves), 6), 0)]
    binned = Binned(None, [list(range(7))] * 6, 0.5, 6)

    def summed() -> tuple[dict, int]:
        out, most = {}, 0
        for batch in R._leaf_sums(jobs, 7, binned, 9)(iter(batches)):
            most = max(most, batch.num_rows)
            for r in batch.to_pylist():
                n, g = out.get(r["part"], (0, 0.0))
                out[r["part"]] = n + np.frombuffer(r["n"], np.uint32), g + np.frombuffer(r["g"])
        return out, most

    (whole, most), times = summed(), R._draws(np.arange(4 * BLOCK, dtype=np.uint64), 0, 9)
    assert most == 2 and sum(n.sum() for n, _ in whole.values()) == 2 * times.sum()
    for name, value in (("ROWS_HELD", 600), ("CELLS_HELD", 1), ("ROWS_SUMMED", 37)):
        monkeypatch.setattr(R, name, value)
        parts, most = summed()
        assert most == (2 if name == "ROWS_HELD" else 1) and parts.keys() == whole.keys()
        for part, (n, g) in parts.items():
            assert (n == whole[part][0]).all() and g == pytest.approx(whole[part][1])


def test_rare_values_have_their_bin(rows):
    rare = rows.withColumn("features", array_to_vector(F.array((F.col("i") < 3).cast("double"), F.lit(1.0))))
    assert R.RandomForest(1).prepare(rare).edges == [[0.0], []]


def test_constant_values_are_kept(rows):
    model = R.RandomForest(3, depth=2).fit(rows.withColumn("value", F.lit(7.25)))
    assert {r["prediction"] for r in model.transform(rows).collect()} == {7.25}


def test_what_cannot_be_fitted_is_refused(rows):
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="finite value"):
            R.RandomForest(1).fit(rows.withColumn("value", F.when(F.col("i") > 3, F.col("value")).otherwise(F.lit(bad).cast("double"))))
    with pytest.raises(ValueError, match="no rows"):
        R.RandomForest(1).fit(rows.filter("i < 0"))
    with pytest.raises(PythonException, match="not finite"):
        R.RandomForest(1).fit(rows.withColumn("features", array_to_vector(F.array(F.lit(float("inf")), F.col("value")))))


def test_stored_forest_predicts_the_same(spark, make_panel, tmp_path, monkeypatch):
    draw = np.random.default_rng(1)
    spec = G.calendar_set()
    features = G.feature_table(make_panel({k: list(draw.random(40)) for k in "abc"}), spec)
    model = G.fit_global(features, spec, G.random_forest(3, 5, 4), "rf")
    assert isinstance(model.regressor, R.Forest) and len(model.regressor.trees) == 3
    model.save(str(tmp_path / "m"))
    want = {(r["id"], r["date"]): r["prediction"] for r in model.predict(features).collect()}
    for most in (R.NODES_IN_PLAN, 1):
        monkeypatch.setattr(G, "NODES_IN_PLAN", most)
        scaled = G.load_global(spark, str(tmp_path / "m"))(features)
        assert {(r["id"], r["date"]): r["prediction"] for r in scaled.collect()} == pytest.approx(want)
    plain = BoostedTrees(model.regressor.base, model.regressor.trees, model.regressor.depth, model.regressor.n_features)
    assert want == pytest.approx({(r["id"], r["date"]): r["prediction"] for r in plain.transform(model.vectors(features)).collect()})
