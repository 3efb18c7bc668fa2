"""Queries: global models, per-series models, tuning, stacking, refits.

Boosted models and tuning runs have the full sizes, which are the operators' defaults. The README has their times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.steps import DAY
from panelweave.operators import arma as A
from panelweave.operators import ensembles as E
from panelweave.operators import global_ml as G
from panelweave.operators import per_series as U
from panelweave.operators import ranking as R
from panelweave.operators import scoring as S
from panelweave.operators import splits
from panelweave.operators import stl as L
from panelweave.operators.baselines import baseline_forecasts, with_history
from panelweave.plans.benchmark import replay
from panelweave.plans.panels import regular
from panelweave.plans.queries_diagnostics import MONTH_CELL, TREND_12, decompose_sql
from panelweave.plans.queries_panel import rolling_plan
from panelweave.plans.queries_scoring import WINDOWS, backtest_on, backtest_rows, calibrated_on, slice_long_sql, train_test
from panelweave.plans.registry import query, rounded
from panelweave.plans.twins import HORIZON, twin
from panelweave.session import materialize, new_path, side_by_side

FOREST, DEPTH = 30, 12
FEATURE_SETS = (G.lag_set(), G.calendar_set(), G.hybrid_set())


def _stored_train(spark, sf, panel: str = "PS") -> tuple[DataFrame, DataFrame]:
    train, test = train_test(spark, sf, panel)
    return materialize(train, "train"), test


def _on_every_feature_set(spark, sf, name: str, estimator) -> DataFrame:
    """Holdout forecasts of one kind of model on the lag, calendar and hybrid predictors."""
    train, test = _stored_train(spark, sf)

    def one(spec: G.FeatureSet) -> DataFrame:
        table = materialize(G.feature_table(train, spec), f"features_{spec.name}")
        model = G.fit_global(table, spec, estimator.copy(), f"{name}_{spec.name}")
        # Written on its own: in one plan the sets lie alike by id, and a task would read all three.
        return materialize(G.recursive_forecast(model, train, HORIZON), f"ahead_{spec.name}")

    return S.calibrate(reduce(DataFrame.unionByName, side_by_side(one, FEATURE_SETS)), test)


@query("fc_elastic_net")
def fc_elastic_net(spark, sf):
    return _on_every_feature_set(spark, sf, "elastic_net", G.elastic_net())


@query("fc_gbt")
def fc_gbt(spark, sf):
    return _on_every_feature_set(spark, sf, "gbt", G.gradient_boosting())


@query("fc_gbt_leaf")
def fc_gbt_leaf(spark, sf):
    """Leaf by leaf, best gain first."""
    return _on_every_feature_set(spark, sf, "gbt_leaf", G.leaf_boosting())


@query("fc_random_forest")
def fc_random_forest(spark, sf):
    return _on_every_feature_set(spark, sf, "random_forest", G.random_forest(FOREST, 5, DEPTH))


@query("recursive_forecast")
def recursive_forecast(spark, sf):
    """Recursion over the supplier panel: the number of series grows with the data."""
    train, _ = _stored_train(spark, sf)
    spec = G.lag_set()
    table = materialize(G.feature_table(train, spec), "features_lag")
    return G.recursive_forecast(G.fit_global(table, spec, G.elastic_net(), "elastic_net_lag"), train, HORIZON)


def _per_series(spark, sf, name: str, panel: str = "PS") -> DataFrame:
    train, test = train_test(spark, sf, panel)
    return S.calibrate(U.ok_forecasts(U.fit_per_series(train, HORIZON, [name])), test)


@query("fc_exp_smoothing")
def fc_exp_smoothing(spark, sf):
    return _per_series(spark, sf, "exp_smoothing")


@query("fc_decomp_ets")
def fc_decomp_ets(spark, sf):
    """Robust decomposition by local regression; the adjusted series smoothed, the last season repeated."""
    train, test = _stored_train(spark, sf)
    smooth = lambda adjusted: U.ok_forecasts(U.fit_per_series(adjusted, HORIZON, ["trend_smoothing"]))
    return S.calibrate(L.decomposed_forecast(train, HORIZON, smooth), test)


@query("fc_harmonic")
def fc_harmonic(spark, sf):
    return _per_series(spark, sf, "harmonic")


@query("fc_autoregressive")
def fc_autoregressive(spark, sf):
    """Seasonal ARMA of the order that each series' normal equations speak for."""
    train, test = _stored_train(spark, sf)
    return S.calibrate(A.arma_forecast(A.arma_models(train), HORIZON), test)


@query("arma_state")
def arma_state(spark, sf):
    """Models of all but the last year, stored, read again, advanced by it without a refit, and used ahead."""
    train, test = _stored_train(spark, sf)
    path = new_path(spark, "arma_models")
    A.arma_models(train).write.parquet(path)
    now = A.advance(spark.read.parquet(path), test)
    return A.arma_forecast(now, HORIZON)


@query("unit_root", twin("ps_train", """SELECT a.id, max(n.n) AS n, round(max(n.ss) / (max(n.n) * (max(n.e2) + 2 * sum((1 - k / (n.l + 1.0)) * a.p))), 8) AS statistic
  FROM (SELECT id, count(*) AS n, floor(4 * power(count(*) / 100.0, 0.25)) AS l, sum(e * e) AS e2, sum(s * s) AS ss
        FROM (SELECT id, e, sum(e) OVER (PARTITION BY id ORDER BY date) AS s
              FROM (SELECT id, date, value - avg(value) OVER (PARTITION BY id) AS e FROM ps_train)) GROUP BY id) n
  JOIN (SELECT b.id, k, sum(b.e * c.e) AS p FROM (SELECT unnest(range(1, 13)) AS k) CROSS JOIN
        (SELECT id, row_number() OVER (PARTITION BY id ORDER BY date) AS pos, value - avg(value) OVER (PARTITION BY id) AS e FROM ps_train) b
        JOIN (SELECT id, row_number() OVER (PARTITION BY id ORDER BY date) AS pos, value - avg(value) OVER (PARTITION BY id) AS e FROM ps_train) c
          ON c.id = b.id AND c.pos = b.pos - k GROUP BY 1, 2) a ON a.id = n.id AND a.k <= n.l GROUP BY a.id"""))
def unit_root(spark, sf):
    """KPSS statistic of every series with three rows or more."""
    train, _ = train_test(spark, sf)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("date", "value"))), lambda p: p["value"])
    arrays = train.groupBy("id").agg(ordered.alias("y"))
    found = arrays.select("id", F.size("y").cast("bigint").alias("n"), A.level_statistic(F.col("y")).alias("statistic"))
    return rounded(found.filter("n > 2"), 8, "statistic")


@query("season_strength", twin("ps_train", f"""SELECT id, round(greatest(0, 1 - var_pop(remainder) / nullif(var_pop(season + remainder), 0)), 8) AS strength
  FROM ({decompose_sql('ps_train', TREND_12, MONTH_CELL)}) WHERE remainder IS NOT NULL GROUP BY id"""))
def season_strength(spark, sf):
    return rounded(A.season_strength(train_test(spark, sf)[0]), 8, "strength")


@query("arma_normal_equations", twin("ps_train", """SELECT id, i AS "row", j AS col, count(*) AS n, round(sum(x[i + 1] * x[j + 1]) / 1e6, 3) AS total
  FROM (SELECT id, [1, lag(z, 1) OVER w, lag(z, 2) OVER w, lag(z, 3) OVER w, lag(z, 12) OVER w, z] AS x, lag(z, 12) OVER w AS far
        FROM (SELECT id, date, value - lag(value, 12) OVER (PARTITION BY id ORDER BY date) AS z FROM ps_train)
        WHERE z IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY date))
  CROSS JOIN (SELECT unnest(range(6)) AS i) CROSS JOIN (SELECT unnest(range(6)) AS j) WHERE far IS NOT NULL GROUP BY 1, 2, 3"""))
def arma_normal_equations(spark, sf):
    """What the lag coefficients of the seasonally differenced series are solved from."""
    sums = A.lag_products(train_test(spark, sf)[0], (1, 2, 3, 12), 12).filter("n > 0")
    return sums.withColumn("total", F.round(F.col("total") / 1e6, 3))


@query("fc_residual_boost")
def fc_residual_boost(spark, sf):
    """A bending line with a season, and an autoregression, each with its residuals boosted on the calendar."""
    train, test = _stored_train(spark, sf)
    fits = materialize(
        U.fit_per_series(train, HORIZON, ["piecewise", "autoregression"], include_fitted=True), "fits"
    )

    def one(name: str) -> DataFrame:
        base = fits.filter(F.col("model_id") == name)
        return G.residual_boost(train, base, HORIZON, G.leaf_boosting(), f"{name}_boosted")

    parts = side_by_side(one, ("piecewise", "autoregression"))
    return S.calibrate(reduce(DataFrame.unionByName, parts), test)


@query("fit_candidates_per_series")
def fit_candidates_per_series(spark, sf):
    train, _ = train_test(spark, sf)
    return U.fit_per_series(train, HORIZON)


@query(
    "fit_error_report",
    twin(
        "pd_full",
        """SELECT id, model_id, 'ValueError: needs ' || needs::VARCHAR || ' points, has ' || n::VARCHAR AS error
  FROM (SELECT id, count(*) AS n FROM pd_full GROUP BY id)
  JOIN (SELECT * FROM (VALUES ('seasonal_naive', 28), ('decomp_smoothing', 56), ('autoregression', 5)) AS t(model_id, needs)) ON n < needs""",
    ),
)
def fit_error_report(spark, sf):
    """Candidates that cannot be fitted: a month of days per user is too short for a four-week cycle."""
    days = regular(spark, sf, "PD")
    return U.fit_errors(U.fit_per_series(days, 7, list(U.CANDIDATES), DAY, season=28))


@query("refit_best")
def refit_best(spark, sf):
    """The best global baseline and each series' best candidate, chosen on the holdout, fitted again on all rows."""
    full = regular(spark, sf, "PS")
    train, test = splits.train_rows(full, HORIZON), splits.test_rows(full, HORIZON)
    scored = S.accuracy_by_series(S.calibrate(U.ok_forecasts(U.fit_per_series(train, HORIZON)), test))
    best = materialize(R.best_per_series(scored).select("id", "model_id"), "best")
    local = U.ok_forecasts(U.fit_per_series(full, HORIZON, only=best)).select("id", "model_id", "date", "prediction")
    chosen = R.top_1(S.accuracy_pooled(calibrated_on(train, test)), "rmse")
    common = R.keep_models(baseline_forecasts(full, HORIZON, windows=WINDOWS), chosen)
    return with_history(full, local.unionByName(common.select("id", "model_id", "date", "prediction")))


# --- tuning and stacking ----------------------------------------------------------

SMALL_GRID = ((2, 0.1), (4, 0.3))  # its first depth is that of the stored model in queries_sinks


def _tuning(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    table = materialize(G.feature_table(train, G.calendar_set()), "features_calendar")
    return table, G.tune_grid(table, rolling_plan(train), G.calendar_set())


@query("tune_grid")
def tune_grid(spark, sf):
    return _tuning(_stored_train(spark, sf)[0])[1]


@query("tune_halving")
def tune_halving(spark, sf):
    """A space-filling design of six points over depth and rate, two thirds of them dropped after each round."""
    train, _ = _stored_train(spark, sf)
    table = materialize(G.feature_table(train, G.calendar_set()), "features_calendar")
    return G.tune_halving(table, rolling_plan(train), G.calendar_set(), G.space_filling(6))


def window_scores(spark, sf) -> DataFrame:
    """Slice scores of a grid over the rolling-mean window, in the layout of a tuning run."""
    rows = backtest_rows(spark, sf, windows=WINDOWS, season=None)
    window = F.regexp_extract("model_id", "[0-9]+", 0).cast("bigint")
    return rows.groupBy(F.col("model_id").alias("config"), window.alias("window"), "slice_id").agg(
        S.mae().alias("mae"), S.rmse().alias("rmse")
    )


WINDOW_METRICS_SQL = f"""SELECT model_id AS config, regexp_extract(model_id, '[0-9]+')::BIGINT AS "window", metric, avg(estimate) AS mean,
  count(*) AS n, stddev_samp(estimate) / sqrt(count(*)) AS std_err FROM ({slice_long_sql(WINDOWS, None)}) GROUP BY 1, 2, 3"""


@query("tune_metrics", twin("ps_train steps", f"""SELECT config, "window", metric, round(mean, 4) AS mean, n, round(std_err, 4) AS std_err FROM ({WINDOW_METRICS_SQL})"""))
def tune_metrics(spark, sf):
    return rounded(G.tune_metrics(window_scores(spark, sf), ["window"]), 4, "mean", "std_err")


@query("select_best", twin("ps_train steps", f"""SELECT "window", config FROM ({WINDOW_METRICS_SQL}) WHERE metric = 'rmse' ORDER BY mean, config LIMIT 1"""))
def select_best(spark, sf):
    return G.select_best(G.tune_metrics(window_scores(spark, sf), ["window"]), params=["window"])


@query("finalize_and_fit")
def finalize_and_fit(spark, sf):
    train, test = _stored_train(spark, sf)
    table, per_slice = _tuning(train)
    model = G.finalize_and_fit(table, G.select_best(G.tune_metrics(per_slice)), G.calendar_set())
    return S.calibrate(G.direct_forecast(model, train, HORIZON), test)


def stack_book() -> dict:
    """The forecasters a stack may choose from, each fitted from training rows alone."""

    def lagged(train: DataFrame) -> DataFrame:
        spec = G.lag_set()
        table = materialize(G.feature_table(train, spec), "stack_features")
        return G.recursive_forecast(G.fit_global(table, spec, G.elastic_net(), "elastic_net_lag"), train, HORIZON)

    names = ("rolling_mean_6", "rolling_mean_12", "seasonal_naive_12")
    one = lambda name: lambda train: baseline_forecasts(train, HORIZON).filter(F.col("model_id") == name)
    return {name: one(name) for name in names} | {"elastic_net_lag": lagged}


@query("ensemble_stacked")
def ensemble_stacked(spark, sf):
    """The three best members on the holdout, refitted on every slice; their meta model over their holdout forecasts."""
    train, test = _stored_train(spark, sf)
    book = stack_book()
    ahead = materialize(reduce(DataFrame.unionByName, side_by_side(lambda name: book[name](train).select("id", "model_id", "step", "date", "prediction"), book)), "members")
    board = S.accuracy_pooled(S.calibrate(ahead, test))
    chosen = sorted(r["model_id"] for r in E.stack_base(board, desc="model_id").select("model_id").collect())
    replayed = materialize(replay(train, rolling_plan(train), chosen, book), "stack_slices")
    return S.calibrate(G.stacked_forecast(G.fit_stack(replayed, chosen), ahead, chosen), test)
