"""Queries: baselines, calibration, accuracy, backtests, ensembles, ranking, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.labels import FAMILY_PATTERNS, matches, numbered_label, with_unique_label
from panelweave.operators import compare as C
from panelweave.operators import ensembles as E
from panelweave.operators import ranking as R
from panelweave.operators import scoring as S
from panelweave.operators import splits
from panelweave.operators.baselines import baseline_forecasts, rolling_mean_forecast, seasonal_naive_forecast, with_history
from panelweave.plans.panels import regular, supplier_month
from panelweave.plans.queries_panel import plan_sql, rolling_plan
from panelweave.plans.registry import query, rounded
from panelweave.plans.twins import HORIZON, baseline_sql, twin
from panelweave.session import materialize
from panelweave.sources.external import external_forecasts

WINDOWS = (3, 6, 12, 24)
SEASON = 12
MODELS = tuple(f"rolling_mean_{n}" for n in WINDOWS) + (f"seasonal_naive_{SEASON}",)
GLOBAL_MODELS = ("rolling_mean_6", "rolling_mean_12", "seasonal_naive_12")
LOCAL_MODELS = ("rolling_mean_3", "rolling_mean_24", "seasonal_naive_12")
_GLOBAL = ", ".join(f"'{m}'" for m in GLOBAL_MODELS)
_LOCAL = ", ".join(f"'{m}'" for m in LOCAL_MODELS)

# Places that leave about ten digits of money-sized scores and never meet an exact tie.
ERROR_PLACES = {"mae": 6, "rmse": 4, "mape": 6, "smape": 6, "mase": 8, "rsq": 8}


def rounded_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.round(m, p) for m, p in ERROR_PLACES.items() if m in df.columns})


def rounded_sql(alias: str = "", metrics=tuple(ERROR_PLACES)) -> str:
    return ", ".join(f"round({alias}{m}, {ERROR_PLACES[m]}) AS {m}" for m in metrics)


def train_test(spark: SparkSession, sf: str, panel: str = "PS") -> tuple[DataFrame, DataFrame]:
    full = regular(spark, sf, panel)
    return splits.train_rows(full, HORIZON), splits.test_rows(full, HORIZON)


def calibrated(spark: SparkSession, sf: str, panel: str = "PS") -> DataFrame:
    return calibrated_on(*train_test(spark, sf, panel))


def calibrated_on(train: DataFrame, test: DataFrame) -> DataFrame:
    return S.calibrate(baseline_forecasts(train, HORIZON, windows=WINDOWS, season=SEASON), test)


def stored_calibration(spark: SparkSession, sf: str, panel: str = "PS") -> DataFrame:
    """Calibrated once, for queries that score and then reuse the forecasts."""
    return materialize(calibrated(spark, sf, panel), "calibrated")


# --- forecasters and scores -----------------------------------------------------


@query(
    "flagship",
    twin(
        "pm_acc_id",
        f"SELECT model_id, id, {rounded_sql()}, n, n_zero_actual FROM pm_acc_id WHERE model_id = 'seasonal_naive_12'",
    ),
)
def flagship(spark, sf):
    """Panel, holdout, seasonal naive, six metrics by series."""
    train, test = train_test(spark, sf, "PM")
    scores = S.accuracy_by_series(S.calibrate(seasonal_naive_forecast(train, HORIZON), test))
    return rounded_metrics(scores)


def _one_model(name: str) -> str:
    return twin("ps_fc", f"SELECT id, model_id, step, date, round(prediction, 6) AS prediction FROM ps_fc WHERE model_id = '{name}'")


@query("fc_rolling_mean_6", _one_model("rolling_mean_6"))
def fc_rolling_mean_6(spark, sf):
    train, _ = train_test(spark, sf)
    return rounded(rolling_mean_forecast(train, HORIZON, 6), 6, "prediction")


@query("fc_rolling_mean_12", _one_model("rolling_mean_12"))
def fc_rolling_mean_12(spark, sf):
    train, _ = train_test(spark, sf)
    return rounded(rolling_mean_forecast(train, HORIZON, 12), 6, "prediction")


@query("fc_seasonal_naive", _one_model("seasonal_naive_12"))
def fc_seasonal_naive(spark, sf):
    train, _ = train_test(spark, sf)
    return rounded(seasonal_naive_forecast(train, HORIZON), 6, "prediction")


@query(
    "future_forecast",
    twin(
        "ps_full steps",
        """SELECT id, date, round(value, 6) AS value, 'actual' AS key, NULL::VARCHAR AS model_id FROM ps_full
  UNION ALL SELECT id, (last_date + to_months(step::INTEGER))::DATE, round(value, 6), 'prediction', 'seasonal_naive_12'
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS rn, max(date) OVER (PARTITION BY id) AS last_date
        FROM ps_full) JOIN steps ON rn = 12 - (step - 1) % 12""",
    ),
)
def future_forecast(spark, sf):
    full = regular(spark, sf, "PS")
    return rounded(with_history(full, seasonal_naive_forecast(full, HORIZON)), 6, "value")


@query(
    "calibrate",
    twin("ps_cal", """SELECT model_id, id, date, step, round(actual, 6) AS actual, round(prediction, 6) AS prediction,
  round(residual, 6) AS residual FROM ps_cal"""),
)
def calibrate(spark, sf):
    return rounded(calibrated(spark, sf), 6, "actual", "prediction", "residual").select(
        "model_id", "id", "date", "step", "actual", "prediction", "residual"
    )


@query("accuracy_pooled", twin("ps_acc", f"SELECT model_id, {rounded_sql()}, n, n_zero_actual FROM ps_acc"))
def accuracy_pooled(spark, sf):
    return rounded_metrics(S.accuracy_pooled(calibrated(spark, sf)))


@query("accuracy_by_series", twin("ps_acc_id", f"SELECT model_id, id, {rounded_sql()}, n, n_zero_actual FROM ps_acc_id"))
def accuracy_by_series(spark, sf):
    return rounded_metrics(S.accuracy_by_series(calibrated(spark, sf)))


def _metric(name: str, expression: str) -> None:
    """Register one metric on its own, by model over all rows."""
    places = ERROR_PLACES[name]
    column = {"rmse": S.rmse, "mae": S.mae, "mape": S.mape, "smape": S.smape, "rsq": S.rsq}[name]

    @query(f"metric_{name}", twin("ps_cal", f"SELECT model_id, round({expression}, {places}) AS {name} FROM ps_cal GROUP BY model_id"))
    def run(spark, sf):
        return rounded_metrics(calibrated(spark, sf).groupBy("model_id").agg(column().alias(name)))


_metric("rmse", "sqrt(avg(power(actual - prediction, 2)))")
_metric("mae", "avg(abs(actual - prediction))")
_metric("mape", "100 * avg(abs((actual - prediction) / nullif(actual, 0)))")
_metric("smape", "100 * avg(abs(actual - prediction) / nullif((abs(actual) + abs(prediction)) / 2, 0))")
_metric("rsq", "power(corr(actual, prediction), 2)")


@query("metric_mase", twin("ps_acc_id", "SELECT model_id, id, round(mase, 8) AS mase FROM ps_acc_id"))
def metric_mase(spark, sf):
    return rounded(S.accuracy_by_series(calibrated(spark, sf)), 8, "mase").select("model_id", "id", "mase")


def outside_forecast(train: DataFrame) -> DataFrame:
    """A forecast in the layout outside models deliver: median and two quantiles by name."""
    tail = splits.panel_tail(train, SEASON)
    ranges = tail.groupBy("id").agg(F.min("value").alias("0.1"), F.max("value").alias("0.9"))
    middle = rolling_mean_forecast(train, HORIZON, SEASON).select("id", "date", F.col("prediction").alias("0.5"))
    return middle.join(ranges, "id")


_OUTSIDE_SQL = """SELECT f.id, f.date, f.prediction, r.lo, r.hi, t.value AS actual
  FROM ps_fc f JOIN (SELECT id, min(value) AS lo, max(value) AS hi FROM ps_tail WHERE rn <= 12 GROUP BY id) r ON r.id = f.id
  JOIN ps_test t ON t.id = f.id AND t.date = f.date WHERE f.model_id = 'rolling_mean_12'"""


@query(
    "external_forecasts",
    twin(
        "ps_fc ps_tail",
        """SELECT 'outside' AS model_id, f.id, f.date, round(f.prediction, 6) AS prediction, r.lo, r.hi FROM ps_fc f
  JOIN (SELECT id, min(value) AS lo, max(value) AS hi FROM ps_tail WHERE rn <= 12 GROUP BY id) r ON r.id = f.id
  WHERE f.model_id = 'rolling_mean_12'""",
    ),
)
def external_forecasts_query(spark, sf):
    train, _ = train_test(spark, sf)
    return rounded(external_forecasts(outside_forecast(train), "outside"), 6, "prediction")


@query(
    "external_accuracy",
    twin(
        "ps_fc ps_tail ps_test",
        f"""SELECT 'outside' AS model_id, coalesce(id, 'all') AS id, round(sqrt(avg(power(actual - prediction, 2))), 4) AS rmse,
  round(avg(abs(actual - prediction)), 6) AS mae, round(100 * avg(abs((actual - prediction) / nullif(actual, 0))), 6) AS mape
  FROM ({_OUTSIDE_SQL}) GROUP BY GROUPING SETS ((), (id))""",
    ),
)
def external_accuracy(spark, sf):
    train, test = train_test(spark, sf)
    scored = materialize(S.calibrate(external_forecasts(outside_forecast(train), "outside"), test), "outside")
    overall = S.external_accuracy(scored).withColumn("id", F.lit("all"))
    return rounded_metrics(overall.unionByName(S.external_accuracy(scored, ["model_id", "id"])))


@query(
    "coverage_check",
    twin(
        "ps_fc ps_tail ps_test",
        f"""SELECT 'outside' AS model_id, round(avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 8) AS coverage,
  count(*) AS n FROM ({_OUTSIDE_SQL})""",
    ),
)
def coverage_check(spark, sf):
    train, test = train_test(spark, sf)
    scored = S.calibrate(external_forecasts(outside_forecast(train), "outside"), test)
    return rounded(S.coverage(scored), 8, "coverage")


@query(
    "forecast_interval",
    twin(
        "ps_cal",
        """SELECT c.model_id, c.id, c.date, round(prediction, 6) AS prediction, round(prediction - w, 7) AS lo,
  round(prediction + w, 7) AS hi, round(prediction - p, 7) AS pooled_lo FROM ps_cal c
  JOIN (SELECT model_id, id, quantile_cont(abs(residual), 0.95) AS w FROM ps_cal GROUP BY 1, 2) b
    ON b.model_id = c.model_id AND b.id = c.id
  JOIN (SELECT model_id, quantile_cont(abs(residual), 0.95) AS p FROM ps_cal GROUP BY 1) q ON q.model_id = c.model_id""",
    ),
)
def forecast_interval(spark, sf):
    cal = stored_calibration(spark, sf)
    ahead = cal.select("model_id", "id", "date", "prediction")
    own = S.forecast_interval(ahead, cal)
    pooled = S.residual_bands(cal, by_id=False).withColumnRenamed("half_width", "pooled")
    both = own.join(F.broadcast(pooled), "model_id").withColumn("pooled_lo", F.col("prediction") - F.col("pooled")).drop("pooled")
    return rounded(rounded(both, 6, "prediction"), 7, "lo", "hi", "pooled_lo")


# --- backtest ---------------------------------------------------------------------

_SLICE_TAIL = f"""SELECT s.slice_id, t.id, t.date, t.value,
  row_number() OVER (PARTITION BY s.slice_id, t.id ORDER BY t.date DESC) AS rn,
  max(t.date) OVER (PARTITION BY s.slice_id, t.id) AS last_date, count(*) OVER (PARTITION BY s.slice_id, t.id) AS n_rows
  FROM ps_train t JOIN {plan_sql('ps_train')} s ON t.date BETWEEN s.train_start AND s.train_end"""


def backtest_sql(windows: tuple[int, ...], season: int | None) -> str:
    """Out-of-sample rows of the baselines on every slice."""
    return f"""SELECT f.slice_id, f.model_id, f.id, f.date, f.prediction, t.value AS actual FROM (
  WITH bt_tail AS ({_SLICE_TAIL}) {baseline_sql('bt_tail', windows, season, 'slice_id, id')}) f
  JOIN {plan_sql('ps_train')} s ON s.slice_id = f.slice_id AND f.date BETWEEN s.test_start AND s.test_end
  JOIN ps_train t ON t.id = f.id AND t.date = f.date"""


_BACKTEST = backtest_sql((6, 12), 12)


def backtest_rows(spark: SparkSession, sf: str, windows: tuple[int, ...] = (6, 12), season: int | None = SEASON) -> DataFrame:
    """Out-of-sample rows of the baselines on every slice, in one query."""
    return backtest_on(materialize(train_test(spark, sf)[0], "train"), windows, season)


def backtest_on(train: DataFrame, windows: tuple[int, ...] = (6, 12), season: int | None = SEASON) -> DataFrame:
    rows = splits.cv_rows(train, rolling_plan(train))
    fitted_on = rows.filter(F.col("role") == "training")
    truth = rows.filter(F.col("role") == "testing").select("slice_id", "id", "date", F.col("value").alias("actual"))
    ahead = baseline_forecasts(fitted_on, HORIZON, windows=windows, season=season, keys=("slice_id", "id"))
    return ahead.join(truth, ["slice_id", "id", "date"])


@query(
    "backtest",
    twin("ps_train steps", f"""SELECT slice_id, model_id, id, date, round(prediction, 6) AS prediction, round(actual, 6) AS actual
  FROM ({_BACKTEST})"""),
)
def backtest(spark, sf):
    rows = backtest_rows(spark, sf).select("slice_id", "model_id", "id", "date", "prediction", "actual")
    return rounded(rows, 6, "prediction", "actual")


def slice_long_sql(windows: tuple[int, ...], season: int | None) -> str:
    """One row per slice, model and metric."""
    scores = f"""SELECT slice_id, model_id, sqrt(avg(power(actual - prediction, 2))) AS rmse, avg(abs(actual - prediction)) AS mae
  FROM ({backtest_sql(windows, season)}) GROUP BY 1, 2"""
    return f"""SELECT model_id, 'rmse' AS metric, rmse AS estimate FROM ({scores})
  UNION ALL SELECT model_id, 'mae', mae FROM ({scores})"""


_SLICE_LONG = slice_long_sql((6, 12), 12)


@query(
    "backtest_accuracy",
    twin("ps_train steps", f"""SELECT model_id, metric, round(avg(estimate), 4) AS mean, count(*) AS n,
  round(stddev_samp(estimate) / sqrt(count(*)), 4) AS std_err FROM ({_SLICE_LONG}) GROUP BY 1, 2"""),
)
def backtest_accuracy(spark, sf):
    return rounded(S.backtest_accuracy(backtest_rows(spark, sf)), 4, "mean", "std_err")


# --- ensembles --------------------------------------------------------------------

_TOP = """(SELECT * FROM (SELECT *, rank() OVER (ORDER BY rmse) AS rk FROM ps_acc) WHERE rk <= {k})"""
_MEMBERS = f"ps_cal WHERE model_id IN (SELECT model_id FROM {_TOP.format(k=4)})"


def scores_and_members(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calibrated rows, the four best models, and the forecasts of those."""
    cal = stored_calibration(spark, sf)
    candidates = materialize(E.ensemble_candidates(S.accuracy_pooled(cal)), "candidates")
    return cal, candidates, E.member_forecasts(cal, candidates)


@query("ensemble_candidates", twin("ps_acc ps_cal", f"""SELECT model_id, id, date, round(prediction, 6) AS prediction FROM {_MEMBERS}"""))
def ensemble_candidates(spark, sf):
    _, _, members = scores_and_members(spark, sf)
    return rounded(members.select("model_id", "id", "date", "prediction"), 6, "prediction")


def _combined(how: str, body: str, names: str = "ps_acc ps_cal") -> None:
    @query(f"ensemble_{how}", twin(names, body))
    def run(spark, sf):
        _, candidates, members = scores_and_members(spark, sf)
        return rounded(E.combine(members, candidates, how), 8, "prediction")


for _how, _agg in (("mean", "avg"), ("median", "median")):
    _combined(
        _how,
        f"""SELECT id, date, 'ensemble_{_how}' AS model_id, round({_agg}(prediction), 8) AS prediction, count(*) AS n_members
  FROM {_MEMBERS} GROUP BY id, date""",
    )
_combined(
    "weighted",
    f"""SELECT c.id, c.date, 'ensemble_weighted' AS model_id, round(sum(c.prediction * (5 - w.rk)) / sum(5 - w.rk), 8) AS prediction,
  count(*) AS n_members FROM ps_cal c JOIN {_TOP.format(k=4)} w ON w.model_id = c.model_id GROUP BY c.id, c.date""",
)


def model_dimension(spark: SparkSession) -> DataFrame:
    """The registered models with a description and a family."""
    rows = [(m, m.upper().replace("ROLLING_MEAN_", "WINDOW FUNC ").replace("SEASONAL_NAIVE_", "SNAIVE "), "classical") for m in MODELS]
    return R.model_table(spark, rows)


_DESC = "replace(replace(upper(model_id), 'ROLLING_MEAN_', 'WINDOW FUNC '), 'SEASONAL_NAIVE_', 'SNAIVE ')"


@query("stack_base", twin("ps_acc", f"""SELECT model_id, {_DESC} AS model_desc, round(rmse, 4) AS rmse FROM
  (SELECT *, rank() OVER (ORDER BY rmse) AS rk FROM ps_acc WHERE NOT regexp_matches({_DESC}, 'DEEPAR|DEEPSTATE|GP FORECASTER', 'i')) WHERE rk <= 3"""))
def stack_base(spark, sf):
    named = materialize(S.accuracy_pooled(calibrated(spark, sf)), "accuracy").join(model_dimension(spark), "model_id")
    return rounded(E.stack_base(named).select("model_id", "model_desc", "rmse"), 4, "rmse")


@query("model_registry", twin("ps_fc", f"""SELECT model_id, {_DESC} AS model_desc, 'classical' AS family, count(*) AS n_forecasts,
  count(DISTINCT id) AS n_series FROM ps_fc GROUP BY 1"""))
def model_registry(spark, sf):
    train, _ = train_test(spark, sf)
    per_model = baseline_forecasts(train, HORIZON, windows=WINDOWS).groupBy("model_id").agg(
        F.count("*").alias("n_forecasts"), F.count_distinct("id").alias("n_series")
    )
    return per_model.join(model_dimension(spark), "model_id")


@query("relabel_models", twin("ps_fc", f"""SELECT model_id, CASE WHEN model_id = 'rolling_mean_6' THEN 'Half-year mean' ELSE {_DESC} END AS model_desc,
  count(*) AS n FROM ps_fc GROUP BY 1, 2"""))
def relabel_models(spark, sf):
    train, _ = train_test(spark, sf)
    named = R.relabel(model_dimension(spark), "model_desc", {"rolling_mean_6": "Half-year mean"})
    ahead = baseline_forecasts(train, HORIZON, windows=WINDOWS).join(named, "model_id")
    return ahead.groupBy("model_id", "model_desc").agg(F.count("*").alias("n"))


@query("family_filter", twin("ps_acc", f"""SELECT model_id, model_desc, family, round(rmse, 4) AS rmse FROM
  (SELECT model_id, {_DESC} AS model_desc, 'classical' AS family, rmse FROM ps_acc)
  WHERE regexp_matches(model_desc, 'SNAIVE|WINDOW|ETS|TBATS|ARIMA|NNETAR|NNAR|SEASONAL DECOMP')"""))
def family_filter(spark, sf):
    named = S.accuracy_pooled(calibrated(spark, sf)).join(model_dimension(spark), "model_id")
    classical = named.filter(matches(F.col("model_desc"), FAMILY_PATTERNS["classical"], ignore_case=False))
    return rounded(classical.select("model_id", "model_desc", "family", "rmse"), 4, "rmse")


# --- ranking ----------------------------------------------------------------------


@query("top_k_ties", twin("ps_acc_id", """SELECT id, model_id, round(rmse, 4) AS rmse FROM
  (SELECT *, rank() OVER (PARTITION BY id ORDER BY rmse) AS rk FROM ps_acc_id) WHERE rk <= 3"""))
def top_k_ties(spark, sf):
    scores = S.accuracy_by_series(calibrated(spark, sf))
    return rounded(R.top_k_ties(scores, "rmse", 3, ["id"]).select("id", "model_id", "rmse"), 4, "rmse")


@query("top_1", twin("ps_acc", f"SELECT model_id, {rounded_sql()} FROM ps_acc ORDER BY ps_acc.rmse, model_id LIMIT 1"))
def top_1(spark, sf):
    best = R.top_1(S.accuracy_pooled(calibrated(spark, sf)), "rmse")
    return rounded_metrics(best).drop("n", "n_zero_actual")


@query("head_n", twin("ps_acc_id", "SELECT id || '/' || model_id AS model_id, round(rmse, 4) AS rmse FROM ps_acc_id ORDER BY ps_acc_id.rmse, 1 LIMIT 10"))
def head_n(spark, sf):
    scores = S.accuracy_by_series(calibrated(spark, sf)).select(F.concat_ws("/", "id", "model_id").alias("model_id"), "rmse")
    return rounded(R.head_n(scores, "rmse", 10), 4, "rmse")


@query("order_by", twin("ps", "SELECT id, date, value FROM ps ORDER BY id, date"))
def order_by(spark, sf):
    return supplier_month(spark, sf).orderBy("id", "date")


@query("best_per_series", twin("ps_acc_id ps_cal", """SELECT c.id, c.date, c.model_id, round(c.prediction, 6) AS prediction, round(b.rmse, 4) AS rmse
  FROM ps_cal c JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rmse, model_id) AS rn FROM ps_acc_id)
  WHERE rn = 1) b ON b.id = c.id AND b.model_id = c.model_id"""))
def best_per_series(spark, sf):
    cal = stored_calibration(spark, sf)
    best = R.best_per_series(S.accuracy_by_series(cal)).select("id", "model_id", "rmse")
    chosen = cal.join(best, ["id", "model_id"]).select("id", "date", "model_id", "prediction", "rmse")
    return rounded(rounded(chosen, 6, "prediction"), 4, "rmse")


@query("union_benchmarks", twin("ps_acc ps_acc_id", """SELECT model_id, NULL::VARCHAR AS id, round(rmse, 4) AS rmse, round(mase, 8) AS mase FROM ps_acc
  UNION ALL SELECT model_id, id, round(rmse, 4), NULL FROM ps_acc_id"""))
def union_benchmarks(spark, sf):
    sums = materialize(S.series_sums(calibrated(spark, sf)), "sums")
    pooled = S.pool_series(sums).select("model_id", "rmse", "mase")
    by_id = S.series_metrics(sums).select("model_id", "id", "rmse")
    return rounded(rounded(R.union_benchmarks([pooled, by_id]), 4, "rmse"), 8, "mase").select("model_id", "id", "rmse", "mase")


@query("combine_model_tables", twin("ps_fc pm_fc", """SELECT model_id, source, count(*) AS n FROM
  (SELECT 'PS' AS source, model_id FROM ps_fc UNION ALL SELECT 'PM', model_id FROM pm_fc) GROUP BY 1, 2"""))
def combine_model_tables(spark, sf):
    parts = []
    for name in ("PS", "PM"):
        train, _ = train_test(spark, sf, name)
        parts.append(baseline_forecasts(train, HORIZON, windows=WINDOWS).withColumn("source", F.lit(name)))
    return R.union_benchmarks(parts).groupBy("model_id", "source").agg(F.count("*").alias("n"))


# --- joins and comparisons ----------------------------------------------------------

_GLOBAL_BEST = f"(SELECT model_id FROM ps_acc WHERE model_id IN ({_GLOBAL}) ORDER BY rmse, model_id LIMIT 1)"
_GVL = f"""SELECT g.id, g.rmse AS global_rmse, g.mae AS global_mae, g.mape AS global_mape, l.model_id AS local_model,
  l.rmse AS local_rmse, l.mae AS local_mae, l.mape AS local_mape,
  CASE WHEN g.rmse < l.rmse THEN 'Global' WHEN l.rmse < g.rmse THEN 'Series-Specific' ELSE 'Tie' END AS winner,
  g.rmse - l.rmse AS rmse_improvement, 100 * (g.rmse - l.rmse) / nullif(g.rmse, 0) AS rmse_improvement_pct, g.model_id AS global_model
  FROM (SELECT * FROM ps_acc_id WHERE model_id = {_GLOBAL_BEST}) g
  JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rmse, model_id) AS rn FROM ps_acc_id
        WHERE model_id IN ({_LOCAL})) WHERE rn = 1) l ON l.id = g.id"""
_GVL_ROUNDED = """id, round(global_rmse, 4) AS global_rmse, round(global_mae, 6) AS global_mae, round(global_mape, 6) AS global_mape,
  local_model, round(local_rmse, 4) AS local_rmse, round(local_mae, 6) AS local_mae, round(local_mape, 6) AS local_mape, winner,
  round(rmse_improvement, 4) AS rmse_improvement, round(rmse_improvement_pct, 6) AS rmse_improvement_pct"""
GVL_PLACES = {
    "global_rmse": 4, "global_mae": 6, "global_mape": 6, "local_rmse": 4, "local_mae": 6, "local_mape": 6,
    "rmse_improvement": 4, "rmse_improvement_pct": 6,
}


def global_and_local(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By-series scores of the best global model, each series' own best, and the pooled table."""
    sums = materialize(S.series_sums(calibrated(spark, sf)), "sums")
    pooled = S.pool_series(sums)
    by_id = S.series_metrics(sums)
    chosen = R.top_1(pooled.filter(F.col("model_id").isin(*GLOBAL_MODELS)), "rmse")
    local = R.best_per_series(by_id.filter(F.col("model_id").isin(*LOCAL_MODELS)))
    return R.keep_models(by_id, chosen), local, pooled


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    chosen, local, _ = global_and_local(spark, sf)
    return C.global_vs_local(chosen, local)


def _round_by(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, p) for c, p in places.items() if c in df.columns})


@query("join_global_local", twin("ps_acc ps_acc_id", f"SELECT id, round(global_rmse, 4) AS global_rmse, local_model, round(local_rmse, 4) AS local_rmse FROM ({_GVL})"))
def join_global_local(spark, sf):
    chosen, local, _ = global_and_local(spark, sf)
    right = local.select("id", F.col("model_id").alias("local_model"), F.col("rmse").alias("local_rmse"))
    joined = chosen.select("id", F.col("rmse").alias("global_rmse")).join(right, "id")
    return _round_by(joined, GVL_PLACES)


@query("join_truth_forecast", twin("ps_fc ps_test", """SELECT t.id, t.date, round(t.value, 6) AS value, f.model_id, round(f.prediction, 6) AS prediction
  FROM ps_test t JOIN ps_fc f ON f.id = t.id AND f.date = t.date"""))
def join_truth_forecast(spark, sf):
    train, test = train_test(spark, sf)
    ahead = baseline_forecasts(train, HORIZON, windows=WINDOWS).select("id", "date", "model_id", "prediction")
    return rounded(test.join(ahead, ["id", "date"]), 6, "value", "prediction")


@query("missing_forecasts", twin("ps_fc ps_test", """SELECT t.id, t.date, m.model_id FROM ps_test t
  CROSS JOIN (SELECT DISTINCT model_id FROM ps_fc UNION ALL SELECT 'absent') m
  WHERE NOT EXISTS (SELECT 1 FROM ps_fc f WHERE f.id = t.id AND f.date = t.date AND f.model_id = m.model_id)"""))
def missing_forecasts(spark, sf):
    train, test = train_test(spark, sf)
    ahead = baseline_forecasts(train, HORIZON, windows=WINDOWS)
    return S.missing_forecasts(test, ahead, [*MODELS, "absent"])


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    by_id = materialize(S.accuracy_by_series(calibrated(spark, sf)), "by_series")
    left = by_id.filter(F.col("model_id") == "rolling_mean_12")
    right = by_id.filter(F.col("model_id") == "seasonal_naive_12")
    return C.two_model_winner(left, right, "mean12", "snaive12")


_PAIR = """SELECT a.id, a.rmse AS mean12_rmse, a.mae AS mean12_mae, a.mape AS mean12_mape, b.rmse AS snaive12_rmse,
  b.mae AS snaive12_mae, b.mape AS snaive12_mape,
  CASE WHEN a.rmse < b.rmse THEN 'mean12' WHEN b.rmse < a.rmse THEN 'snaive12' ELSE 'Tie' END AS winner
  FROM ps_acc_id a JOIN ps_acc_id b ON b.id = a.id AND a.model_id = 'rolling_mean_12' AND b.model_id = 'seasonal_naive_12'"""


@query("join_two_models", twin("ps_acc_id", f"SELECT id, round(mean12_rmse, 4) AS mean12_rmse, round(snaive12_rmse, 4) AS snaive12_rmse FROM ({_PAIR})"))
def join_two_models(spark, sf):
    return rounded(_pair(spark, sf).select("id", "mean12_rmse", "snaive12_rmse"), 4, "mean12_rmse", "snaive12_rmse")


@query("two_model_winner", twin("ps_acc_id", f"SELECT winner, count(*) AS n FROM ({_PAIR}) GROUP BY 1"))
def two_model_winner(spark, sf):
    return R.count_sorted(_pair(spark, sf), "winner")


@query("global_vs_local", twin("ps_acc ps_acc_id", f"SELECT {_GVL_ROUNDED} FROM ({_GVL})"))
def global_vs_local(spark, sf):
    return _round_by(comparison(spark, sf), GVL_PLACES)


@query("global_vs_local_summary", twin("ps_acc ps_acc_id", f"SELECT winner, count(*) AS n FROM ({_GVL}) GROUP BY 1"))
def global_vs_local_summary(spark, sf):
    return R.count_sorted(comparison(spark, sf), "winner")


@query("gap_long", twin("ps_acc ps_acc_id", f"""SELECT id, 'Global' AS strategy, round(global_rmse, 4) AS rmse, round(abs(rmse_improvement), 4) AS rmse_gap FROM ({_GVL})
  UNION ALL SELECT id, 'Series-Specific', round(local_rmse, 4), round(abs(rmse_improvement), 4) FROM ({_GVL})"""))
def gap_long(spark, sf):
    long = C.gap_long(materialize(comparison(spark, sf), "comparison")).orderBy("rmse_gap", "id", "strategy")
    return rounded(long, 4, "rmse", "rmse_gap")


@query("final_benchmark", twin("ps_acc ps_fc ps_tail ps_test", f"""SELECT model_id, round(rmse, 4) AS rmse, round(mae, 6) AS mae, round(mape, 6) AS mape FROM
  (SELECT model_id, rmse, mae, mape FROM ps_acc UNION ALL
   SELECT 'outside', sqrt(avg(power(actual - prediction, 2))), avg(abs(actual - prediction)),
     100 * avg(abs((actual - prediction) / nullif(actual, 0))) FROM ({_OUTSIDE_SQL}))"""))
def final_benchmark(spark, sf):
    train, test = train_test(spark, sf)
    outside = S.external_accuracy(S.calibrate(external_forecasts(outside_forecast(train), "outside"), test))
    board = C.final_benchmark([S.accuracy_pooled(calibrated_on(train, test)), outside])
    return rounded_metrics(board)


@query("leaderboard_chart_data", twin("ps_acc_id", """SELECT id || ' [' || model_id || ']' AS model_label, id || CASE WHEN k = 0 THEN '' ELSE '.' || k::VARCHAR END AS unique_label,
  round(rmse, 4) AS rmse, row_number() OVER (ORDER BY rmse, id, model_id) AS display_rank FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rmse, model_id) - 1 AS k FROM
    (SELECT * FROM ps_acc_id ORDER BY rmse, id, model_id LIMIT 15))"""))
def leaderboard_chart_data(spark, sf):
    scores = S.accuracy_by_series(calibrated(spark, sf)).select("id", "model_id", "rmse")
    first = materialize(scores.orderBy("rmse", "id", "model_id").limit(15), "leaders")
    named = with_unique_label(first, "id", "unique_label", [F.col("rmse"), F.col("model_id")])
    labelled = named.withColumn("model_label", numbered_label(F.col("id"), F.col("model_id"))).withColumn(
        "_tie", F.concat_ws("/", "id", "model_id")
    )
    ranked = R.display_rank(labelled, "rmse", "_tie")
    return rounded(ranked.select("model_label", "unique_label", "rmse", "display_rank"), 4, "rmse")


@query("hybrid_policy", twin("ps_acc ps_acc_id", f"""SELECT id, CASE WHEN winner = 'Series-Specific' THEN local_model ELSE global_model END AS model_id,
  CASE WHEN winner = 'Series-Specific' THEN winner ELSE 'Global' END AS source, round(least(global_rmse, local_rmse), 4) AS rmse FROM ({_GVL})"""))
def hybrid_policy(spark, sf):
    chosen, local, _ = global_and_local(spark, sf)
    return rounded(C.hybrid_policy(chosen, local), 4, "rmse")


@query("run_summary", twin("ps_acc ps_acc_id", f"""SELECT 'top_models' AS section, model_id AS item, round(rmse, 4) AS value FROM ps_acc
  UNION ALL SELECT 'global_vs_local', winner, count(*)::DOUBLE FROM ({_GVL}) GROUP BY winner"""))
def run_summary(spark, sf):
    chosen, local, pooled = global_and_local(spark, sf)
    summary = C.run_summary(pooled, C.global_vs_local(chosen, local))
    return rounded(summary, 4, "value")
