from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from panelweave.operators import diagnostics as D
from panelweave.operators import global_ml as G
from panelweave.operators import per_series as U
from panelweave.operators import scoring as S
from panelweave.operators import splits
from panelweave.operators.features import lag_features
from panelweave.session import materialize
from tests.conftest import month

SEASON = [100 + 10 * np.sin(2 * np.pi * t / 12) for t in range(60)]


@pytest.fixture(scope="module")
def noisy_panel(make_panel):
    rng = np.random.default_rng(11)
    return make_panel({k: [50 + i * 20 + t + 8 * np.cos(t * np.pi / 6) + rng.normal(0, 1) for t in range(72)] for i, k in enumerate("abc")})


# --- diagnostics ------------------------------------------------------------------


def test_decompose_pure_season(make_panel):
    rows = D.decompose(make_panel({"a": SEASON})).orderBy("date").collect()
    inner = [r for r in rows if r["trend"] is not None]
    assert len(inner) == 48
    assert max(abs(r["remainder"]) for r in inner) < 1e-9
    assert abs(sum(r["season"] for r in rows[:12])) < 1e-9
    assert all(r["remainder"] is None for r in rows if r["trend"] is None)


def test_spike_is_flagged_and_cleaned(make_panel):
    rng = np.random.default_rng(5)
    series = [v + rng.normal(0, 0.5) for v in SEASON]
    series[30] += 80
    found = D.anomalies(make_panel({"a": series})).filter("is_anomaly").collect()
    assert [r["date"] for r in found] == [month(30)]
    cleaned = D.outlier_clean(make_panel({"a": series})).filter("is_cleaned").collect()
    assert [r["date"] for r in cleaned] == [month(30)]
    assert abs(cleaned[0]["value"] - SEASON[30]) < 6 and cleaned[0]["value_raw"] == pytest.approx(series[30])


def test_acf_and_pacf_against_numpy(make_panel):
    x = np.random.default_rng(2).normal(0, 1, 40).cumsum()
    got = [r["acf"] for r in D.acf(make_panel({"a": list(x)}), 10).orderBy("lag").collect()]
    c = x - x.mean()
    r = np.array([(c[k:] * c[: len(c) - k]).sum() for k in range(11)]) / (c * c).sum()
    assert got == pytest.approx(list(r))
    part = [row["pacf"] for row in D.pacf(make_panel({"a": list(x)}), 6).orderBy("lag").collect()]
    want = [np.linalg.solve(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), r[1 : k + 1])[-1] for k in range(1, 7)]
    assert part == pytest.approx(want)


def test_acf_stops_before_the_series_ends(make_panel):
    out = D.acf(make_panel({"a": [1, 2, 4, 1], "flat": [3, 3]}), 60).collect()
    assert sorted(r["lag"] for r in out if r["id"] == "a") == [0, 1, 2, 3]
    assert all(r["acf"] is None for r in out if r["id"] == "flat")


def test_ts_summary_counts_steps_between_rows(spark):
    days = [1, 1, 1, 2, 4, 8]
    df = spark.createDataFrame([(dt.date(2020, 1, d),) for d in days], "date date")
    r = D.ts_summary(df, "date").first()
    steps = np.diff(days) * 86400.0
    assert r["n_obs"] == 6 and r["diff_mean"] == pytest.approx(steps.mean())
    assert (r["diff_minimum"], r["diff_q1"], r["diff_median"], r["diff_q3"], r["diff_maximum"]) == tuple(np.quantile(steps, [0, 0.25, 0.5, 0.75, 1]))


# --- per-series models ------------------------------------------------------------


def test_level_smoothing_matches_the_python_fit(make_panel):
    rng = np.random.default_rng(4)
    y = rng.normal(100, 5, 40)
    got = U.level_smoothing(make_panel({"a": list(y)}), 3).collect()
    want = U.fit_level_smoothing(y, 3, 12)
    assert [r["prediction"] for r in got] == pytest.approx(list(want.path))
    assert f"alpha={got[0]['alpha']} " in want.params


def test_straight_line_is_continued():
    y = 10 + 2.0 * np.arange(48)
    want = 10 + 2.0 * np.arange(48, 54)
    assert U.fit_harmonic(y, 6, 12).path == pytest.approx(list(want))
    assert U.fit_autoregression(y, 6, 12).path == pytest.approx(list(want))


def test_pure_season_is_continued():
    y = np.array(SEASON)
    want = [100 + 10 * np.sin(2 * np.pi * t / 12) for t in range(60, 84)]
    for name in ("seasonal_naive", "harmonic", "autoregression", "decomp_smoothing", "exp_smoothing"):
        assert U.CANDIDATES[name](y, 24, 12).path == pytest.approx(want, abs=0.5), name


def test_fitted_values_are_one_step_ahead():
    y = np.random.default_rng(1).normal(10, 1, 40)
    fit = U.fit_level_smoothing(y, 1, 12)
    alpha = float(fit.params.split()[0].split("=")[1])
    level = y[0]
    for t in range(1, 40):
        assert fit.fitted[t] == pytest.approx(level)
        level = alpha * y[t] + (1 - alpha) * level


def test_fits_travel_without_the_package(tmp_path):
    """Workers have no copy of the package; the fits must load from the pickled task alone."""
    (tmp_path / "fits").write_bytes(cloudpickle.dumps(U.CANDIDATES))
    code = "import pickle, numpy as np; f = pickle.load(open('fits', 'rb')); print(len(f['exp_smoothing'](np.arange(1., 40.), 3, 12).path))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "3", done.stderr


def test_failed_fit_is_a_row(make_panel):
    fits = U.fit_per_series(make_panel({"a": list(range(1, 41)), "tiny": [1, 2, 3]}), 4, ["seasonal_naive", "harmonic"])
    errors = U.fit_errors(fits).collect()
    assert [(r["id"], r["model_id"]) for r in errors] == [("tiny", "seasonal_naive")]
    assert U.ok_forecasts(fits).filter("id = 'a'").count() == 8


def test_refit_only_runs_the_chosen_model(spark, make_panel):
    only = spark.createDataFrame([("a", "harmonic"), ("b", "seasonal_naive")], "id string, model_id string")
    fits = U.fit_per_series(make_panel({"a": SEASON, "b": SEASON}), 2, only=only, candidates=["harmonic", "seasonal_naive"])
    assert {(r["id"], r["model_id"]) for r in fits.collect()} == {("a", "harmonic"), ("b", "seasonal_naive")}


# --- global models ----------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(noisy_panel):
    return materialize(splits.train_rows(noisy_panel, 12), "train"), splits.test_rows(noisy_panel, 12)


@pytest.fixture(scope="module")
def linear(stored):
    spec = G.hybrid_set(12)
    table = materialize(G.feature_table(stored[0], spec), "features")
    return G.fit_global(table, spec, G.elastic_net(), "en")


def test_first_recursive_step_sees_the_training_features(stored, linear):
    """Features of the next period from the tail equal those the feature table gives it."""
    train, test = stored
    first = test.groupBy("id").agg(F.min("date").alias("date"), F.min_by("value", "date").alias("value"))
    longer = train.unionByName(first.select("id", "date", "value"))
    table = G.feature_table(longer, linear.spec).join(first.select("id", "date"), ["id", "date"])
    direct = {r["id"]: r["prediction"] for r in G.score_rows(linear, table).collect()}
    step1 = {r["id"]: r["prediction"] for r in G.recursive_forecast(linear, train, 1).collect()}
    assert step1 == pytest.approx(direct)


def test_linear_fold_equals_the_chained_steps(stored, linear):
    train, _ = stored
    assert isinstance(linear.regressor, LinearRegressionModel)
    folded = G.recursive_forecast(linear, train, 8)
    tails = G.series_tails(train, linear.spec.tail_length)
    state = linear.with_levels(tails).withColumn("calendar", G._calendar_steps(linear, 8, G.MONTH))
    chained = {r["id"]: r["path"] for r in G._chained_path(linear, state, 8, 3).collect()}
    by_id: dict = {}
    for r in folded.orderBy("id", "step").collect():
        by_id.setdefault(r["id"], []).append(r["prediction"])
    for key, path in by_id.items():
        assert path == pytest.approx(chained[key])


def test_tail_k_is_lag_k(stored):
    train, _ = stored
    tails = {r["id"]: r["tail"] for r in G.series_tails(train, 24).collect()}
    last = train.groupBy("id").agg(F.max("date").alias("date"))
    lags = lag_features(train.unionByName(last.select("id", F.add_months("date", 1).alias("date"), F.lit(None).cast("double").alias("value")))).filter("value is null")
    for r in lags.collect():
        assert [r[f"value_lag{k}"] for k in range(1, 25)] == tails[r["id"]]
        assert r["value_lag12_roll_12"] == pytest.approx(np.mean(tails[r["id"]][11:23]))


def test_linear_model_beats_the_mean_on_a_trending_season(stored, linear):
    train, test = stored
    r = S.accuracy_pooled(S.calibrate(G.recursive_forecast(linear, train, 12), test)).first()
    assert r["n"] == 36 and r["mase"] < 1


def test_trees_recurse_over_a_write(stored):
    train, test = stored
    spec = G.lag_set(12)
    model = G.fit_global(materialize(G.feature_table(train, spec), "f"), spec, G.random_forest(5, 2, 4), "rf")
    a = G.recursive_forecast(model, train, 5, steps_per_write=2)
    b = G.recursive_forecast(model, train, 5, steps_per_write=99)
    assert a.exceptAll(b).count() == 0 and a.count() == 15


def test_predictors_of_a_series_do_not_depend_on_the_panel(spark):
    months = F.explode(F.sequence(F.lit(0), F.lit(15)))
    every = spark.range(10_000).select(F.col("id").cast("string").alias("id"), months.alias("t"))
    value = (F.xxhash64("id", "t") % 1000).cast("double")
    wide = every.select("id", F.add_months(F.lit(month(0)), F.col("t")).alias("date"), value.alias("value"))
    spec, seen = G.lag_set(3), []
    for panel in (wide.filter("cast(id as int) < 10"), wide):
        model = G.unfitted(G.feature_table(panel, spec), spec, "m")
        rows = model.vectors(G.feature_table(panel, spec)).filter("id = '7'").orderBy("date").collect()
        seen.append([list(r["features"]) for r in rows])
        assert len(seen[-1]) == 13 and len(seen[-1][0]) == len(G.LEVELS) + 3
    assert seen[0] == seen[1]


def test_levels_of_a_series(make_panel):
    values = [1.0, 5.0, 2.0, 8.0]
    levels = {r["id"]: r for r in G.series_levels(make_panel({"a": values, "one": [3.0]}), season=2).collect()}
    assert levels["a"]["id_mean"] == 4.0 and levels["a"]["id_recent"] == 5.0
    assert levels["a"]["id_spread"] == pytest.approx(np.std(values, ddof=1)) and levels["one"]["id_spread"] == 0.0


def test_unseen_series_takes_the_mean_levels(linear, make_panel):
    got = linear.with_levels(make_panel({"new": [1.0]})).first()
    assert {c: got[c] for c in G.LEVELS} == linear.common


def test_short_series_is_left_to_the_completeness_check(stored, linear, make_panel):
    train, _ = stored
    more = train.unionByName(make_panel({"tiny": [1, 2, 3]}))
    assert G.recursive_forecast(linear, more, 2).filter("id = 'tiny'").count() == 0


def test_tuning_summary(spark):
    rows = [("c1", 1, 0.1, s, float(s), float(s) * 2) for s in (1, 2, 3)] + [("c2", 2, 0.1, s, 1.0, 1.0) for s in (1, 2, 3)]
    per_slice = spark.createDataFrame(rows, "config string, tree_depth bigint, learn_rate double, slice_id bigint, mae double, rmse double")
    metrics = G.tune_metrics(per_slice)
    got = {(r["config"], r["metric"]): r for r in metrics.collect()}
    assert got["c1", "rmse"]["mean"] == 4.0 and got["c1", "rmse"]["n"] == 3
    assert got["c1", "rmse"]["std_err"] == pytest.approx(2 / np.sqrt(3))
    assert G.select_best(metrics).first()["config"] == "c2"
    assert [r["config"] for r in G.show_best(metrics, "rmse").collect()] == ["c2", "c1"]


def test_published_tuning_table_selects_depth_3(spark):
    means = (0.665521, 0.106884, 0.815296, 0.123138, 0.469525, 0.111742)
    rows = [(f"c{i}", d, r, "rmse", m, 3, 0.0) for i, ((d, r), m) in enumerate(zip(G.TUNING_GRID, means))]
    metrics = spark.createDataFrame(rows, "config string, tree_depth bigint, learn_rate double, metric string, mean double, n bigint, std_err double")
    best = G.select_best(metrics).first()
    assert best["tree_depth"] == 3 and best["learn_rate"] == pytest.approx(0.316228, abs=1e-6)


def test_space_filling_design():
    points = G.space_filling(6)
    depths, rates = sorted(d for d, _ in points), sorted(np.log10(r) for _, r in points)
    assert len(set(depths)) == 6 and 1 <= depths[0] and depths[-1] <= 15 and points == G.space_filling(6)
    assert np.allclose(np.diff(rates), 2.5 / 6) and G.space_filling(1)[0][0] == 8


def test_halving_keeps_the_best(spark, make_panel):
    rng = np.random.default_rng(4)
    panel = make_panel({f"s{i}": [10 * i + 5 * np.sin(t / 2) + rng.normal(0, 0.1) for t in range(60)] for i in range(4)})
    table = materialize(G.feature_table(panel, G.calendar_set()), "halving_features")
    plan = splits.cv_plan(panel, 30, 6, 6, 2)
    grid = [(1, 0.001), (3, 0.5), (1, 0.002), (2, 0.001)]
    rows = G.tune_halving(table, plan, G.calendar_set(), grid, trees=4, share=2).collect()
    by_round = {n: sorted({r.config for r in rows if r["round"] == n}) for n in (1, 2)}
    assert by_round[1] == [f"config_{i}" for i in range(1, 5)] and "config_2" in by_round[2] and len(by_round[2]) == 2
    assert {(r["round"], r.trees) for r in rows} == {(1, 2), (2, 4)} and len({r.slice_id for r in rows}) == 2


def test_change_points_are_found():
    draw = np.random.default_rng(2)
    t = np.arange(120)
    line = 5 + 0.5 * t - 1.2 * np.maximum(t - 40, 0) + 1.6 * np.maximum(t - 85, 0)
    y = line + 3 * np.sin(2 * np.pi * t / 12) + 0.4 * draw.normal(size=120)
    fit = U.fit_piecewise(y, 24, 12)
    cuts = list(map(int, fit.params.split()))
    assert len(cuts) == 2 and abs(cuts[0] - 40) <= 3 and abs(cuts[1] - 85) <= 3
    ahead = np.arange(120, 144)
    truth = 5 + 0.5 * ahead - 1.2 * (ahead - 40) + 1.6 * (ahead - 85) + 3 * np.sin(2 * np.pi * ahead / 12)
    assert np.abs(fit.path - truth).max() < 4 < np.abs(U.fit_harmonic(y, 24, 12).path - truth).max()
    cost = U.segment_costs(y)
    for i, j in ((0, 30), (17, 23), (50, 52), (0, 120)):
        own = np.polyfit(t[i:j], y[i:j], 1)
        assert abs(cost[i, j] - ((y[i:j] - np.polyval(own, t[i:j])) ** 2).sum()) < 1e-6
    for n in (1, 2, 5, 13, 24):
        short = U.fit_piecewise(y[:n], 3, 12)
        assert len(short.path) == 3 and np.isfinite(short.path).all()


def test_time_folds_keep_a_slice_together(spark):
    rows = [(s, month(6 * s + t), f"s{i}") for s in (2, 5, 9) for t in range(12) for i in range(3)]
    table = spark.createDataFrame(rows, "slice_id bigint, date date, id string")
    found = G.time_folds(table).groupBy("slice_id").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).collect()
    assert {r.slice_id: (r.a, r.b) for r in found} == {2: (0, 0), 5: (1, 1), 9: (2, 2)}
    one = G.time_folds(table.filter("slice_id = 2"), 4).groupBy("date").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).orderBy("date").collect()
    assert [r.a for r in one] == [r.b for r in one] == [i // 3 for i in range(12)]


def test_stack_learns_the_better_member(spark):
    rng = np.random.default_rng(9)
    rows = []
    for t in range(60):
        a = float(rng.normal(10, 3))
        rows += [(1, "s", month(t), "good", a + 0.01, a), (1, "s", month(t), "bad", float(rng.normal(10, 3)), a)]
    df = spark.createDataFrame(rows, "slice_id bigint, id string, date date, model_id string, prediction double, actual double")
    meta = G.fit_stack(df, ["bad", "good"])
    weights = meta.coefficients.toArray()
    assert weights[1] > 0.9 > 10 * abs(weights[0])
    out = G.stacked_forecast(meta, df.drop("actual"), ["bad", "good"])
    assert out.count() == 60


def test_series_fitted_side_by_side_keep_their_numbers(spark, monkeypatch):
    """Series of all lengths, signs and gaps: rows of a joint call are those of one call per series."""
    draw = np.random.default_rng(5)
    known = {f"s{i}": draw.normal(50, 20 + 30 * (i % 2), 1 + 7 * (i % 7)) for i in range(14)}
    known["gap"] = np.append(known["s6"], np.nan)
    rows = [(k, dt.date(2000 + i // 12, i % 12 + 1, 1), None if np.isnan(v) else float(v)) for k, y in known.items() for i, v in enumerate(y)]
    panel = spark.createDataFrame(rows, "id string, date date, value double")
    names = ["exp_smoothing", "decomp_smoothing", "autoregression"]
    calls = []
    monkeypatch.setitem(U.TOGETHER, "exp_smoothing", lambda ys, h, m: calls.append(len(ys)) or U.exp_smoothings(ys, h, m))
    U._attempts(U.fit_exp_smoothing, U.TOGETHER["exp_smoothing"], list(known.values()), 3, 12)
    assert sorted(calls) == [2] * 7  # one call for all series of a length
    monkeypatch.undo()
    got = {(r["id"], r["model_id"], r["step"]): r for r in U.fit_per_series(panel, 3, names, include_fitted=True).collect()}
    n = 0
    for k, y in known.items():
        for name in names:
            try:
                if np.isnan(y).any():
                    raise ValueError("series has missing values")
                fit = U.CANDIDATES[name](y, 3, 12)
            except Exception as problem:
                row, n = got[k, name, 0], n + 1
                assert (row["status"], row["error"], row["date"]) == ("error", f"{type(problem).__name__}: {problem}", None)
                continue
            for step, value in zip(range(1 - len(y), 4), [*fit.fitted, *fit.path]):
                row, n = got[k, name, step], n + 1
                assert row["prediction"] == (None if np.isnan(value) else value) and (row["variant"], row["params"]) == (fit.variant, fit.params)
    assert n == len(got)


def test_replayed_parts_are_written_on_their_own(spark):
    """The union of all parts has nothing left to shuffle, so no task reads every part."""
    from panelweave.operators.baselines import baseline_forecasts
    from panelweave.plans.benchmark import replay

    days = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(30)]
    panel = spark.createDataFrame([(k, d, float(i)) for k in ("a", "b") for i, d in enumerate(days)], "id string, date date, value double")
    plan = spark.createDataFrame([(s, days[0], days[11 + s], days[12 + s], days[14 + s]) for s in (1, 2)], "slice_id long, train_start date, train_end date, test_start date, test_end date")
    one = lambda name: lambda train: baseline_forecasts(train, 12).filter(F.col("model_id") == name)
    names = ("rolling_mean_6", "seasonal_naive_12")
    rows = replay(panel, plan, names, {name: one(name) for name in names})
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.groupBy("slice_id", "model_id").count().filter("count = 6").count() == 4


def test_forecasts_of_a_feature_set_are_written_on_their_own(spark, tmp_path):
    """What is left of a model query reads written forecasts: no window or vector of any set stands in its plan."""
    from panelweave.plans.queries_models import _on_every_feature_set

    days = [dt.datetime(2000 + i // 12, i % 12 + 1, 3) for i in range(60)]
    rows = [(1, k, d, 100.0 * k + i % 12 + i * k) for k in (1, 2, 3) for i, d in enumerate(days)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_shipdate timestamp, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = _on_every_feature_set(spark, str(tmp_path), "elastic_net", G.elastic_net())
    assert {r["model_id"]: r["count"] for r in found.groupBy("model_id").count().collect()} == {f"elastic_net_{s}": 36 for s in ("lag", "calendar", "hybrid")}
    plan = found.filter("prediction is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "aggregate(" not in plan
