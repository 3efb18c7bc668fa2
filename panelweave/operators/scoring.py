"""Calibration, accuracy, intervals and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.quantiles import exact_quantiles
from panelweave.operators.panel import by_time
from panelweave.session import materialize

METRICS = ("mae", "mape", "mase", "smape", "rmse", "rsq")


def calibrate(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """Forecasts next to the actual value of the same id and date."""
    actual = truth.select("id", "date", F.col("value").alias("actual"))
    return forecasts.join(actual, ["id", "date"]).withColumn("residual", F.col("actual") - F.col("prediction"))


def missing_forecasts(truth: DataFrame, forecasts: DataFrame, models: Sequence[str]) -> DataFrame:
    """Truth rows that a model has no forecast for; empty when all holdouts are equal."""
    wanted = truth.select("id", "date").withColumn(
        "model_id", F.explode(F.array(*[F.lit(m) for m in models]))
    )
    return wanted.join(forecasts.select("id", "date", "model_id"), ["id", "date", "model_id"], "left_anti")


def absolute_error() -> Column:
    return F.abs(F.col("actual") - F.col("prediction"))


def squared_error() -> Column:
    return F.pow(F.col("actual") - F.col("prediction"), 2)


def percentage_error() -> Column:
    """Null where the actual is zero, so that such rows are skipped."""
    return F.abs(F.try_divide(F.col("actual") - F.col("prediction"), F.col("actual"))) * 100


def symmetric_error() -> Column:
    return F.try_divide(absolute_error(), (F.abs("actual") + F.abs("prediction")) / 2) * 100


def rmse() -> Column:
    return F.sqrt(F.avg(squared_error()))


def mae() -> Column:
    return F.avg(absolute_error())


def mape() -> Column:
    return F.avg(percentage_error())


def smape() -> Column:
    return F.avg(symmetric_error())


def rsq() -> Column:
    """Squared correlation; null when one side is constant."""
    spread = (F.var_pop("actual") > 0) & (F.var_pop("prediction") > 0)
    return F.when(spread, F.pow(F.try_divide(F.covar_pop("actual", "prediction"), F.sqrt(F.var_pop("actual") * F.var_pop("prediction"))), 2))


def series_sums(calibrated: DataFrame, keys: Sequence[str] = ("model_id", "id")) -> DataFrame:
    """Everything the metrics need, one row per model and series.

    One exchange on (model, id) serves the naive-step window and the aggregate;
    pooled scores are rolled up from this small table.
    """
    scored = calibrated.filter(F.col("actual").isNotNull() & F.col("prediction").isNotNull())
    step = F.abs(F.col("actual") - F.lag("actual").over(by_time(keys)))
    return scored.withColumn("_step", step).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("actual") == 0).alias("n_zero_actual"),
        F.sum(absolute_error()).alias("abs_sum"),
        F.sum(squared_error()).alias("sq_sum"),
        F.sum(percentage_error()).alias("pct_sum"),
        F.count(percentage_error()).alias("pct_n"),
        F.sum(symmetric_error()).alias("sym_sum"),
        F.count(symmetric_error()).alias("sym_n"),
        F.avg("_step").alias("naive_step"),
        F.avg("actual").alias("mean_a"),
        F.avg("prediction").alias("mean_p"),
        F.var_pop("actual").alias("var_a"),
        F.var_pop("prediction").alias("var_p"),
        F.covar_pop("actual", "prediction").alias("cov"),
    )


def _rsq_from(cov: Column, var_a: Column, var_p: Column) -> Column:
    return F.when((var_a > 0) & (var_p > 0), F.pow(F.try_divide(cov, F.sqrt(var_a * var_p)), 2))


def accuracy_by_series(calibrated: DataFrame, keys: Sequence[str] = ("model_id", "id")) -> DataFrame:
    """Six metrics per model and series."""
    return series_metrics(series_sums(calibrated, keys), keys)


def series_metrics(sums: DataFrame, keys: Sequence[str] = ("model_id", "id")) -> DataFrame:
    """Six metrics from :func:`series_sums`."""
    mean_abs = F.col("abs_sum") / F.col("n")
    return sums.select(
        *keys,
        mean_abs.alias("mae"),
        F.try_divide("pct_sum", "pct_n").alias("mape"),
        F.try_divide(mean_abs, F.col("naive_step")).alias("mase"),
        F.try_divide("sym_sum", "sym_n").alias("smape"),
        F.sqrt(F.col("sq_sum") / F.col("n")).alias("rmse"),
        _rsq_from(F.col("cov"), F.col("var_a"), F.col("var_p")).alias("rsq"),
        "n",
        "n_zero_actual",
    )


def accuracy_pooled(calibrated: DataFrame, keys: Sequence[str] = ("model_id",), series: Sequence[str] = ("id",)) -> DataFrame:
    """Six metrics per model over all rows; MASE is the mean of the series' own values.

    Means, variances and covariances of the series combine to the pooled ones,
    so the rows are read once; the sums, one row per model and series, are stored.
    """
    return pool_series(series_sums(calibrated, (*keys, *series)), keys)


def pool_series(sums: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Roll :func:`series_sums` up to ``keys``."""
    n = F.col("n")
    sums = materialize(sums, "series_sums")
    # Spread within the series plus spread of their means around the grand mean: no large squares cancel.
    grand = sums.groupBy(*keys).agg(
        (F.sum(n * F.col("mean_a")) / F.sum("n")).alias("ma"), (F.sum(n * F.col("mean_p")) / F.sum("n")).alias("mp")
    )
    off_a, off_p = F.col("mean_a") - F.col("ma"), F.col("mean_p") - F.col("mp")
    rolled = sums.join(grand, list(keys)).withColumn("_mase", F.try_divide(F.col("abs_sum") / n, F.col("naive_step"))).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("n_zero_actual").alias("n_zero_actual"),
        *[F.sum(c).alias(c) for c in ("abs_sum", "sq_sum", "pct_sum", "pct_n", "sym_sum", "sym_n")],
        F.avg("_mase").alias("mase"),
        F.sum(n * (F.col("var_a") + off_a * off_a)).alias("all_a"),
        F.sum(n * (F.col("var_p") + off_p * off_p)).alias("all_p"),
        F.sum(n * (F.col("cov") + off_a * off_p)).alias("all_ap"),
    )
    return rolled.select(
        *keys,
        (F.col("abs_sum") / n).alias("mae"),
        F.try_divide("pct_sum", "pct_n").alias("mape"),
        "mase",
        F.try_divide("sym_sum", "sym_n").alias("smape"),
        F.sqrt(F.col("sq_sum") / n).alias("rmse"),
        _rsq_from(F.col("all_ap"), F.col("all_a"), F.col("all_p")).alias("rsq"),
        "n",
        "n_zero_actual",
    )


def mase_rowwise(truth: DataFrame) -> DataFrame:
    """Mean one-step change over all rows taken in (date, id) order, series mixed.

    Only a check against published pooled scores that used this denominator. The
    rows are range-partitioned by (date, id) and written with their part number;
    steps are taken inside a part, and the parts' first and last values are
    chained afterwards, so no date (it holds every series) sits in one task.
    """
    ordered = truth.select("date", "id", "value").orderBy("date", "id")
    rows = materialize(ordered.withColumn("part", F.spark_partition_id()), "row_order")
    inside = Window.partitionBy("part").orderBy("date", "id")
    steps = rows.withColumn("step", F.abs(F.col("value") - F.lag("value").over(inside)))
    place = F.struct("date", "id")
    parts = steps.groupBy("part").agg(
        F.sum("step").alias("total"),
        F.count("step").alias("n"),
        F.min_by("value", place).alias("head"),
        F.max_by("value", place).alias("tail"),
    )
    bridged = parts.withColumn("bridge", F.abs(F.col("head") - F.lag("tail").over(Window.orderBy("part"))))
    total = F.coalesce(F.sum("total"), F.lit(0.0)) + F.coalesce(F.sum("bridge"), F.lit(0.0))
    return bridged.agg(F.try_divide(total, F.sum("n") + F.count("bridge")).alias("naive_step"))


def external_accuracy(calibrated: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Three metrics for forecasts made elsewhere, overall or by series."""
    return calibrated.groupBy(*by).agg(rmse().alias("rmse"), mae().alias("mae"), mape().alias("mape"))


def residual_bands(calibrated: DataFrame, level: float = 0.95, by_id: bool = True) -> DataFrame:
    """Half-width of the forecast interval: a quantile of the absolute holdout residual.

    Per series the residuals are bounded by the horizon; the pooled variant
    ranges over all series and takes the distributed quantile.
    """
    size = calibrated.withColumn("_abs", F.abs("residual"))
    if by_id:
        return size.groupBy("model_id", "id").agg(F.percentile("_abs", F.lit(level)).alias("half_width"))
    return exact_quantiles(size, ["model_id"], "_abs", [level], ["half_width"], few_groups=True)


def forecast_interval(forecasts: DataFrame, calibrated: DataFrame, level: float = 0.95, by_id: bool = True) -> DataFrame:
    """Forecasts with ``lo`` and ``hi``; pooled bands are one row per model and broadcast.

    A forecast of a model or series that has no residuals keeps its row, without bounds.
    """
    bands = residual_bands(calibrated, level, by_id)
    keys = ["model_id", "id"] if by_id else ["model_id"]
    bands = bands if by_id else F.broadcast(bands)
    return forecasts.join(bands, keys, "left").select(
        *forecasts.columns,
        (F.col("prediction") - F.col("half_width")).alias("lo"),
        (F.col("prediction") + F.col("half_width")).alias("hi"),
    )


def coverage(calibrated: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Share of actual values inside ``[lo, hi]``."""
    inside = F.col("actual").between(F.col("lo"), F.col("hi")).cast("int")
    return calibrated.groupBy(*by).agg(F.avg(inside).alias("coverage"), F.count("*").alias("n"))


def backtest_accuracy(calibrated: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Metric per slice first, then mean, count and standard error over slices."""
    per_slice = calibrated.groupBy(*keys, "slice_id").agg(rmse().alias("rmse"), mae().alias("mae"))
    return metric_summary(per_slice, keys)


def metric_summary(per_slice: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ("mae", "rmse")) -> DataFrame:
    """``(keys…, metric, mean, n, std_err)`` from one row per slice."""
    long = per_slice.unpivot([*keys, "slice_id"], list(metrics), "metric", "estimate")
    return long.groupBy(*keys, "metric").agg(
        F.avg("estimate").alias("mean"),
        F.count("estimate").alias("n"),
        (F.stddev_samp("estimate") / F.sqrt(F.count("estimate"))).alias("std_err"),
    )
