"""Rolling-mean and seasonal-naive forecasts as plain queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.steps import MONTH, Freq
from panelweave.operators.panel import by_time

ROLLING_WINDOWS = (6, 12)
SEASON = 12


def baseline_forecasts(
    train: DataFrame,
    horizon: int,
    freq: Freq = MONTH,
    windows: Sequence[int] = ROLLING_WINDOWS,
    season: int | None = SEASON,
    keys: Sequence[str] = ("id",),
) -> DataFrame:
    """``(keys…, model_id, step, date, prediction)`` for every series and model at once.

    Only the last rows of a series matter, so a ranked window keeps those, one
    aggregate turns them into all models' inputs, and the horizon is unrolled
    from that single row. ``keys`` may carry a slice id for backtests. A series
    shorter than the season has no seasonal forecast.
    """
    keep = max([*windows, season or 0])
    newest_first = by_time(keys, newest_first=True)
    tail = train.select(*keys, "date", "value", F.row_number().over(newest_first).alias("_rn")).filter(
        F.col("_rn") <= keep
    )
    aggregates = [F.max("date").alias("_last")]
    aggregates += [F.avg(F.when(F.col("_rn") <= n, F.col("value"))).alias(f"_mean_{n}") for n in windows]
    if season:
        recent = F.when(F.col("_rn") <= season, F.struct((-F.col("_rn")).alias("o"), "value"))
        aggregates.append(F.sort_array(F.collect_list(recent)).alias("_season"))
    rows = tail.groupBy(*keys).agg(*aggregates).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    )
    models = [
        F.struct(F.lit(f"rolling_mean_{n}").alias("model_id"), F.col(f"_mean_{n}").alias("prediction"))
        for n in windows
    ]
    if season:
        at = (F.col("step") - 1) % season
        value = F.when(F.size("_season") == season, F.get("_season", at)["value"])
        models.append(F.struct(F.lit(f"seasonal_naive_{season}").alias("model_id"), value.alias("prediction")))
    return (
        rows.withColumn("_model", F.explode(F.array(*models)))
        .select(
            *keys,
            F.col("_model.model_id").alias("model_id"),
            F.col("step").cast("bigint").alias("step"),
            freq.add(F.col("_last"), F.col("step")).alias("date"),
            F.col("_model.prediction").alias("prediction"),
        )
        .filter(F.col("prediction").isNotNull())
    )


def rolling_mean_forecast(train: DataFrame, horizon: int, window: int, freq: Freq = MONTH) -> DataFrame:
    """Mean of the last ``window`` values, repeated over the horizon."""
    return baseline_forecasts(train, horizon, freq, windows=(window,), season=None)


def seasonal_naive_forecast(train: DataFrame, horizon: int, season: int = SEASON, freq: Freq = MONTH) -> DataFrame:
    """The value one season earlier, the last season repeated over the horizon."""
    return baseline_forecasts(train, horizon, freq, windows=(), season=season)


def forecast_calendar(predictions: DataFrame, freq: Freq = MONTH) -> DataFrame:
    """Dates for an array of predictions that start one step after ``last_date``."""
    return predictions.select("id", "last_date", F.posexplode("predictions").alias("_pos", "prediction")).select(
        "id",
        freq.add(F.col("last_date"), F.col("_pos") + 1).alias("date"),
        (F.col("_pos") + 1).cast("bigint").alias("step"),
        "prediction",
    )


def with_history(panel: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Actual rows and predictions in one table, told apart by ``key``; bounds ``lo`` and ``hi`` stay where forecasts have them."""
    bounds = [c for c in ("lo", "hi") if c in forecasts.columns]
    none = [F.lit(None).cast("double").alias(c) for c in bounds]
    history = panel.select("id", "date", "value", F.lit("actual").alias("key"), F.lit(None).cast("string").alias("model_id"), *none)
    ahead = forecasts.select("id", "date", F.col("prediction").alias("value"), F.lit("prediction").alias("key"), "model_id", *bounds)
    return history.unionByName(ahead)
