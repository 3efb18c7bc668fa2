"""The whole benchmark as one run: panel, models, scores, ensembles, comparison, forecasts, files."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.steps import MONTH, Freq
from panelweave.operators import compare as C
from panelweave.operators import diagnostics as D
from panelweave.operators import ensembles as E
from panelweave.operators import global_ml as G
from panelweave.operators import per_series as U
from panelweave.operators import ranking as R
from panelweave.operators import scoring as S
from panelweave.operators import splits
from panelweave.operators.baselines import ROLLING_WINDOWS, baseline_forecasts, with_history
from panelweave.operators.panel import bucket_sum, regular_panel
from panelweave.session import materialize, materialize_by, new_path, side_by_side
from panelweave.sources import sinks
from panelweave.sources.external import external_forecasts
from panelweave.sources.tables import cast_date


@dataclass(frozen=True)
class BenchmarkConfig:
    """Sizes and switches of a run; the defaults are the full-size benchmark."""

    horizon: int = 24
    lags: int = 24
    freq: Freq = MONTH
    plan: Mapping[str, int] = field(
        default_factory=lambda: {"initial": 48, "assess": 12, "skip": 12, "slice_limit": 4}
    )
    zero_is_missing: bool = False
    clean_train: bool = True
    run_tuning: bool = True
    run_stacking: bool = True
    run_series_models: bool = True
    trees: int = 500
    tuning_trees: int = G.TUNING_TREES
    tuning_grid: tuple = G.TUNING_GRID
    panel_models: tuple = ("exp_smoothing", "decomp_smoothing", "harmonic", "autoregression")
    boosted_models: tuple = ("harmonic", "autoregression")
    series_candidates: tuple = U.LOCAL_CANDIDATES
    fits_at_once: int = 4


@dataclass
class BenchmarkRun:
    """Where the result tables of a run are; every table is written once."""

    path: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.tables[name] = materialize(df, name)
        return self.tables[name]

    def keep_by_id(self, name: str, df: DataFrame) -> DataFrame:
        self.tables[name] = materialize_by(df, name)
        return self.tables[name]


Forecaster = Callable[[DataFrame], DataFrame]
TUNED, STACKED = "leaf_boosting_tuned", "ensemble_stacked"


def baseline_forecaster(model_id: str, cfg: BenchmarkConfig) -> Forecaster:
    """One of the baselines on its own, for a refit or a replay on a slice."""

    def run(train: DataFrame) -> DataFrame:
        every = baseline_forecasts(train, cfg.horizon, cfg.freq, season=cfg.freq.season)
        return every.filter(F.col("model_id") == model_id).select("id", "model_id", "step", "date", "prediction")

    return run


def global_forecaster(model_id: str, spec: G.FeatureSet, estimator: Estimator, cfg: BenchmarkConfig) -> Forecaster:
    """Features, fit and forecast of one regressor from training rows alone."""

    def run(train: DataFrame) -> DataFrame:
        features = materialize(G.feature_table(train, spec), f"features_{spec.name}")
        return G.recursive_forecast(G.fit_global(features, spec, estimator, model_id), train, cfg.horizon, cfg.freq)

    return run


def panel_model_id(name: str, boosted: bool = False) -> str:
    """Id of a statistical model on the main board; the per-series candidates keep their plain names."""
    return f"panel_{name}_boosted" if boosted else f"panel_{name}"


def _panel_fits(train: DataFrame, names: Sequence[str], cfg: BenchmarkConfig) -> DataFrame:
    """Statistical models of every series with their fitted rows, each series fitted once for all of them."""
    return U.fit_per_series(train, cfg.horizon, names, cfg.freq, include_fitted=True).filter("status = 'ok'")


def _panel_ahead(fits: DataFrame) -> DataFrame:
    model_id = F.concat(F.lit(panel_model_id("")), "model_id").alias("model_id")
    return U.ok_forecasts(fits).select("id", model_id, "step", "date", "prediction")


def _boosted(train: DataFrame, fits: DataFrame, name: str, cfg: BenchmarkConfig) -> DataFrame:
    """A statistical model plus boosted calendar effects of its residuals."""
    base = fits.filter(F.col("model_id") == name)
    return G.residual_boost(train, base, cfg.horizon, G.leaf_boosting(cfg.trees), panel_model_id(name, True), cfg.freq)


def panel_forecaster(name: str, cfg: BenchmarkConfig, boosted: bool = False) -> Forecaster:
    """One statistical model of every series on its own, for a refit or a replay on a slice."""

    def run(train: DataFrame) -> DataFrame:
        fits = _panel_fits(train, [name], cfg)
        return _boosted(train, materialize(fits, f"fitted_{name}"), name, cfg) if boosted else _panel_ahead(fits)

    return run


def regressors(cfg: BenchmarkConfig) -> dict[str, tuple[G.FeatureSet, Estimator]]:
    """Every kind of regressor on every feature set."""
    kinds = {
        "elastic_net": G.elastic_net(),
        "gbt": G.gradient_boosting(cfg.trees),
        "gbt_leaf": G.leaf_boosting(cfg.trees),
        "random_forest": G.random_forest(cfg.trees),
    }
    specs = (G.lag_set(cfg.lags), G.calendar_set(), G.hybrid_set(cfg.lags))
    return {f"{kind}_{spec.name}": (spec, est) for spec in specs for kind, est in kinds.items()}


def forecaster_book(cfg: BenchmarkConfig) -> dict[str, Forecaster]:
    """Every model that can be fitted again from training rows, by its id."""
    baselines = [f"rolling_mean_{n}" for n in ROLLING_WINDOWS] + [f"seasonal_naive_{cfg.freq.season}"]
    book = {name: baseline_forecaster(name, cfg) for name in baselines}
    book |= {panel_model_id(name): panel_forecaster(name, cfg) for name in cfg.panel_models}
    book |= {panel_model_id(name, True): panel_forecaster(name, cfg, boosted=True) for name in cfg.boosted_models}
    return book | {name: global_forecaster(name, spec, est, cfg) for name, (spec, est) in regressors(cfg).items()}


def global_forecasts(train: DataFrame, cfg: BenchmarkConfig) -> DataFrame:
    """All baselines in one query; the regressors share one feature table per set, the statistical models one pass."""
    every = baseline_forecasts(train, cfg.horizon, cfg.freq, season=cfg.freq.season)
    parts = [every.select("id", "model_id", "step", "date", "prediction")]
    names = list(dict.fromkeys([*cfg.panel_models, *cfg.boosted_models]))
    if names:
        fits = materialize(_panel_fits(train, names, cfg), "panel_fits")
        parts.append(_panel_ahead(fits.filter(F.col("model_id").isin(*cfg.panel_models))))
        parts += side_by_side(lambda name: _boosted(train, fits, name, cfg), cfg.boosted_models, cfg.fits_at_once)
    recipes = regressors(cfg)
    specs = {spec.name: spec for spec, _ in recipes.values()}
    tables = {name: materialize(G.feature_table(train, spec), f"features_{name}") for name, spec in specs.items()}

    def one(recipe) -> DataFrame:
        model_id, (spec, estimator) = recipe
        model = G.fit_global(tables[spec.name], spec, estimator.copy(), model_id)
        return G.recursive_forecast(model, train, cfg.horizon, cfg.freq)

    return reduce(DataFrame.unionByName, [*parts, *side_by_side(one, recipes.items(), cfg.fits_at_once)])


def tuned_forecaster(train: DataFrame, cfg: BenchmarkConfig, run: BenchmarkRun) -> Forecaster:
    """Boosting on calendar predictors with the depth and rate that won on the rolling slices."""
    spec = G.calendar_set()
    features = materialize(G.feature_table(train, spec), "features_calendar")
    plan = splits.cv_plan(train, **cfg.plan)
    metrics = run.keep("tuning", G.tune_metrics(G.tune_grid(features, plan, spec, cfg.tuning_grid, cfg.tuning_trees)))
    best = run.keep("tuning_best", G.select_best(metrics))
    sinks.write_tuning(metrics, best, f"{run.path}/tuning")

    def forecast(rows: DataFrame) -> DataFrame:
        table = materialize(G.feature_table(rows, spec), "features_calendar")
        model = G.finalize_and_fit(table, best, spec, cfg.tuning_trees, TUNED)
        sinks.save_model(model, new_path(rows.sparkSession, TUNED))
        return G.direct_forecast(model, rows, cfg.horizon, cfg.freq)

    return forecast


def panel_from_raw(raw: DataFrame, by: Column, freq: Freq = MONTH, since: str | None = None, until: str | None = None) -> DataFrame:
    """Raw observations (``date``, ``value`` and whatever ``by`` reads) to bucketed ``(id, date, value)``.

    ``by`` names the series: a column, a category rule or a constant for the total. Rows without
    date, value or series go; ``since`` and ``until`` are inclusive days.
    """
    rows = cast_date(raw, "date").withColumn("_series", by)
    if since is not None:
        rows = rows.filter(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.filter(F.col("date") <= F.lit(until).cast("date"))
    return bucket_sum(rows.dropna(subset=["date", "value", "_series"]), [F.col("_series").alias("id")], "date", "value", freq)


def run_raw(raw: DataFrame, by: Column, cfg: BenchmarkConfig = BenchmarkConfig(), outside: Mapping[str, DataFrame] | None = None, **span: str) -> BenchmarkRun:
    """The whole benchmark from raw observations; ``span`` is ``since`` and ``until`` of :func:`panel_from_raw`."""
    return run_benchmark(panel_from_raw(raw, by, cfg.freq, **span), cfg, outside)


def run_benchmark(bucketed: DataFrame, cfg: BenchmarkConfig = BenchmarkConfig(), outside: Mapping[str, DataFrame] | None = None) -> BenchmarkRun:
    """From bucketed observations ``(id, date, value)`` to the final tables.

    ``outside`` maps a model name to its delivered forecasts. The panel, the
    holdout, the forecasts and the per-series scores are each written once and
    every later step reads them: one holdout for all models, one calibration.
    """
    run = BenchmarkRun(new_path(bucketed.sparkSession, "run"))
    panel = run.keep_by_id("panel", regular_panel(bucketed, cfg.freq, cfg.zero_is_missing).select("id", "date", "value"))
    truth = run.keep("truth", splits.test_rows(panel, cfg.horizon))
    raw_train = splits.train_rows(panel, cfg.horizon)
    cleaned = D.outlier_clean(raw_train, cfg.freq).select("id", "date", "value") if cfg.clean_train else raw_train
    train = run.keep_by_id("train", cleaned)
    sinks.write_handover(raw_train, f"{run.path}/handover/context")
    sinks.write_handover(truth, f"{run.path}/handover/truth")

    book = forecaster_book(cfg)
    parts = [global_forecasts(train, cfg)]
    if cfg.run_tuning:
        book[TUNED] = tuned_forecaster(train, cfg, run)
        parts.append(book[TUNED](train))
    forecasts = run.keep("forecasts", reduce(DataFrame.unionByName, parts))
    run.keep("missing_forecasts", S.missing_forecasts(truth, forecasts, list(book)))
    calibrated = run.keep("calibrated", S.calibrate(forecasts, truth))
    sums = run.keep("series_sums", S.series_sums(calibrated))
    pooled = run.keep("global_accuracy", S.pool_series(sums))

    candidates = run.keep("ensemble_members", E.ensemble_candidates(pooled))
    members = E.member_forecasts(calibrated, candidates)
    stack = None
    combined = [E.combine(members, candidates, how).drop("n_members") for how in ("mean", "median", "weighted")]
    if cfg.run_stacking:
        stack = fit_stack(train, pooled, book, cfg, run)
        combined.append(stack(forecasts))
    ensembles = run.keep("ensembles", reduce(DataFrame.unionByName, combined))
    ensemble_sums = run.keep("ensemble_sums", S.series_sums(S.calibrate(ensembles, truth)))
    all_sums = sums.unionByName(ensemble_sums)
    everyone = run.keep("all_models_accuracy", S.pool_series(all_sums))
    sinks.write_accuracy(everyone, f"{run.path}/accuracy", "all_models")
    sinks.write_accuracy(S.pool_series(ensemble_sums), f"{run.path}/accuracy", "ensembles")

    best = run.keep("best_global", R.top_1(everyone, "rmse"))
    best_by_id = run.keep("best_global_by_series", R.keep_models(S.series_metrics(all_sums), best))
    ahead = refit_global(panel, best, candidates, book, stack)
    everything = calibrated.unionByName(S.calibrate(ensembles, truth), allowMissingColumns=True)
    _future(run, "global_future_forecast", panel, ahead, everything)
    boards = [everyone]
    for name, delivered in (outside or {}).items():
        scored = materialize(S.calibrate(external_forecasts(delivered, name), truth), name)
        boards.append(S.external_accuracy(scored))
        run.keep(f"{name}_by_series", S.external_accuracy(scored, ["model_id", "id"]))
    board = run.keep("final_benchmark", C.final_benchmark(boards))
    sinks.write_comparison(R.head_n(board, "rmse", 10), f"{run.path}/top_models")

    if cfg.run_series_models:
        _series_models(panel, raw_train, truth, best_by_id, board, everything, cfg, run)
    return run


def _future(run: BenchmarkRun, name: str, panel: DataFrame, ahead: DataFrame, calibrated: DataFrame) -> None:
    """Future forecasts with bounds from the model's holdout residuals of the same series, kept and written."""
    ahead = S.forecast_interval(ahead.select("id", "model_id", "date", "prediction"), calibrated)
    future = run.keep(name, with_history(panel, ahead))
    sinks.write_forecasts(future.filter(F.col("key") == "prediction").drop("key"), f"{run.path}/{name}")


def replay(train: DataFrame, plan: DataFrame, models: Sequence[str], book: Mapping[str, Forecaster]) -> DataFrame:
    """Out-of-sample rows of the named models: refitted on every slice, kept inside its test dates.

    A part is written on its own: in one plan, parts that lie alike by id are read together, all of them in a task.
    """

    def one(task) -> DataFrame:
        cut, name = task
        seen = train.filter(F.col("date").between(F.lit(cut["train_start"]), F.lit(cut["train_end"])))
        later = train.filter(F.col("date").between(F.lit(cut["test_start"]), F.lit(cut["test_end"])))
        rows = S.calibrate(book[name](seen), later).withColumn("slice_id", F.lit(cut["slice_id"]).cast("bigint"))
        return materialize(rows, "replayed")

    tasks = [(cut, name) for cut in plan.collect() for name in models]
    return reduce(DataFrame.unionByName, side_by_side(one, tasks))


@dataclass(frozen=True)
class Stack:
    """A meta model and its members; call it on forecasts that hold the members."""

    meta: LinearRegressionModel
    members: list[str]

    def __call__(self, forecasts: DataFrame) -> DataFrame:
        return G.stacked_forecast(self.meta, forecasts, self.members)


def fit_stack(train: DataFrame, pooled: DataFrame, book: Mapping[str, Forecaster], cfg: BenchmarkConfig, run: BenchmarkRun) -> Stack:
    """Meta model over the best models that can be refitted on the slices."""
    eligible = E.stack_base(pooled.filter(F.col("model_id").isin(*book)), desc="model_id")
    chosen = sorted(r["model_id"] for r in eligible.select("model_id").collect())
    replayed = run.keep("stack_rows", replay(train, splits.cv_plan(train, **cfg.plan), chosen, book))
    run.keep("stack_accuracy", S.backtest_accuracy(replayed))
    return Stack(G.fit_stack(replayed, chosen), chosen)


def refit_global(panel: DataFrame, best: DataFrame, members: DataFrame, book: Mapping[str, Forecaster], stack: Stack | None) -> DataFrame:
    """Future forecast of the winner fitted again on all rows; an ensemble fits its members again."""
    winner = best.first()["model_id"]
    if winner in book:
        return book[winner](panel)
    stacked = stack is not None and winner == STACKED
    names = stack.members if stacked else [r["model_id"] for r in members.select("model_id").collect()]
    refitted = reduce(DataFrame.unionByName, [book[n](panel) for n in names])
    if stacked:
        return stack(refitted)
    return E.combine(refitted, members, winner.removeprefix("ensemble_")).drop("n_members")


def _series_models(
    panel: DataFrame,
    train: DataFrame,
    truth: DataFrame,
    best_by_id: DataFrame,
    board: DataFrame,
    global_rows: DataFrame,
    cfg: BenchmarkConfig,
    run: BenchmarkRun,
) -> None:
    """Per-series candidates, their comparison with the global winner, and refitted future forecasts."""
    fits = run.keep("series_fits", U.fit_per_series(train, cfg.horizon, cfg.series_candidates, cfg.freq))
    run.keep("series_errors", U.fit_errors(fits))
    sinks.save_series_models(fits, f"{run.path}/models/series")
    own_rows = run.keep("series_calibrated", S.calibrate(U.ok_forecasts(fits).select("id", "model_id", "step", "date", "prediction"), truth))
    scores = run.keep("series_accuracy", S.accuracy_by_series(own_rows))
    sinks.write_accuracy(scores, f"{run.path}/accuracy_by_series", "series_models")
    local = run.keep("best_local", R.best_per_series(scores))
    compared = run.keep("global_vs_local", C.global_vs_local(best_by_id, local))
    sinks.write_comparison(compared, f"{run.path}/global_vs_local")
    sinks.write_comparison(R.count_sorted(compared, "winner"), f"{run.path}/global_vs_local_summary")
    policy = run.keep("hybrid_policy", C.hybrid_policy(best_by_id, local))
    rows = global_rows.unionByName(own_rows, allowMissingColumns=True)
    run.keep("hybrid_accuracy", S.accuracy_pooled(C.policy_rows(policy, rows)))
    run.keep("summary", C.run_summary(board, compared))
    refitted = U.ok_forecasts(U.fit_per_series(panel, cfg.horizon, cfg.series_candidates, cfg.freq, only=local, by_id=True))
    _future(run, "local_future_forecast", panel, refitted, own_rows)
