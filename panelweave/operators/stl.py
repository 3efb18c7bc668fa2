"""Seasonal-trend decomposition by local regression.

Spark shuffles the panel by ``id``; a series, bounded by the calendar, is decomposed in its task.
Local regression weighs the nearest ``span`` points by (1 - d^3)^3 of their distance and by how
far the last pass trusted them, and reads off a straight line through them. The distances depend on
the length of a series only, so a regression at all positions is a few products with fixed matrices.

Inner pass: smooth each place in the cycle over the years (or take its mean: ``periodic``), take
off what a low-pass filter (averages of m, m and 3, then local regression) leaves of it, and
smooth the seasonally adjusted values to the trend. Outer pass: weigh points down by the size of
their remainder (bisquare, six median absolute remainders) and do the inner passes again.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.steps import MONTH, Freq
from panelweave.session import materialize, spread

# The smoothers travel to the workers with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXACT = 1e-9  # remainders below this share of the largest value are no remainders
INNER, OUTER = 1, 15  # passes of the robust form; 2 and 0 are usual without weights


def odd_from(least: float) -> int:
    """The smallest odd number not below."""
    n = math.ceil(least)
    return n if n % 2 else n + 1


def trend_span(m: int, season_span: int | None) -> int:
    return odd_from(1.5 * m / (1 - 1.5 / season_span)) if season_span else odd_from(1.5 * m)


@lru_cache(maxsize=64)
def nearness(n: int, span: int, margin: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Tricube weights and signed distances of the ``span`` points nearest to each position, as two tables.

    A row holds one position from ``-margin`` to ``n - 1 + margin`` and at most ``span`` points.
    """
    at = np.arange(-margin, n + margin)[:, None]
    low = np.clip(at - (span - 1) // 2, 0, max(0, n - span))
    points = low + np.arange(min(span, n))
    reach = np.maximum(at - low, points[:, -1:] - at) + max(span - n, 0) // 2
    d = np.abs(points - at) / np.maximum(reach, 1e-9)
    weights = np.where(d <= 0.001, 1.0, np.where(d > 0.999, 0.0, (1 - np.minimum(d, 1) ** 3) ** 3))
    return weights, points


def local_lines(y: np.ndarray, trust: np.ndarray, span: int, margin: int = 0) -> np.ndarray:
    """Local linear regression at every position, and ``margin`` positions beyond both ends; NaN where nothing has weight."""
    n = len(y)
    near, points = nearness(n, span, margin)
    w, values = near * trust[points], y[points]
    x = points - np.arange(-margin, n + margin)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = w / w.sum(axis=1, keepdims=True)
        middle, level = (w * x).sum(axis=1), (w * values).sum(axis=1)
        scatter = (w * (x - middle[:, None]) ** 2).sum(axis=1)
        slope = (w * (x - middle[:, None]) * values).sum(axis=1) / scatter
        straight = np.sqrt(np.maximum(scatter, 0)) > 0.001 * (n - 1)
    return np.where(straight, level - np.where(straight, slope, 0) * middle, level)


def smoothed(y: np.ndarray, trust: np.ndarray, span: int) -> np.ndarray:
    """Local regression; a position whose neighbours have no weight keeps its value."""
    line = local_lines(y, trust, span)
    return np.where(np.isnan(line), y, line)


def running_mean(y: np.ndarray, width: int) -> np.ndarray:
    return np.convolve(y, np.full(width, 1.0 / width), "valid")


def _cycles(y: np.ndarray, trust: np.ndarray, m: int, span: int | None) -> np.ndarray:
    """Each place of the cycle smoothed over the years, with one cycle more at both ends."""
    out = np.empty(len(y) + 2 * m)
    for k in range(m):
        own, w = y[k::m], trust[k::m]
        if span is None:
            level = (own * w).sum() / w.sum() if w.sum() > 0 else own.mean()
            line = np.full(len(own) + 2, level)
        else:
            line = local_lines(own, w, span, 1)
            line = np.where(np.isnan(line), own[np.clip(np.arange(-1, len(own) + 1), 0, len(own) - 1)], line)
        out[k::m] = line[: len(out[k::m])]
    return out


def parts_of(
    y: np.ndarray, m: int, season_span: int | None = None, t_span: int | None = None, inner: int = INNER, outer: int = OUTER
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and last weights of a series without gaps."""
    n = len(y)
    trend, trust, even = np.zeros(n), np.ones(n), np.ones(n)
    for turn in range(outer + 1):
        if turn:
            rest = np.abs(y - trend - season)  # noqa: F821  set by the first turn
            wide = 6 * np.median(rest)
            if wide <= EXACT * np.abs(y).max():
                break  # what is left is rounding
            with np.errstate(divide="ignore", invalid="ignore"):
                bisquare = (1 - (rest / wide) ** 2) ** 2
            trust = np.where(rest <= 0.001 * wide, 1.0, np.where(rest > 0.999 * wide, 0.0, bisquare))
        for _ in range(inner):
            cycles = _cycles(y - trend, trust, m, season_span)
            low = running_mean(running_mean(running_mean(cycles, m), m), 3)
            season = cycles[m : m + n] - smoothed(low, even, odd_from(m))
            trend = smoothed(y - season, trust, t_span or trend_span(m, season_span))
    if season_span is None:  # the same in every cycle
        season = np.array([season[k::m].mean() for k in range(m)])[np.arange(n) % m]
    return trend, season, trust


def stl(
    panel: DataFrame,
    freq: Freq = MONTH,
    season: int | None = None,
    season_span: int | None = None,
    t_span: int | None = None,
    inner: int = INNER,
    outer: int = OUTER,
) -> DataFrame:
    """``id, date, value, trend, season, remainder, seasadj, weight`` of every row.

    ``season_span`` None keeps the season the same in every cycle. Series shorter than two seasons, or with
    missing values, have no parts (null).
    """
    m = season or freq.season

    def one_series(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        y = rows["value"].to_numpy(dtype=float)
        if len(y) < 2 * m or np.isnan(y).any():
            return rows.assign(trend=None, season=None, weight=None)
        trend, turns, trust = parts_of(y, m, season_span, t_span, inner, outer)
        return rows.assign(trend=trend, season=turns, weight=trust)

    series = spread(panel.select("id", "date", F.col("value").cast("double").alias("value")), "id")
    schema = f"id {dict(series.dtypes)['id']}, date date, value double, trend double, season double, weight double"
    found = series.groupBy("id").applyInPandas(one_series, schema)
    return found.select(
        "id", "date", "value", "trend", "season", (F.col("value") - F.col("trend") - F.col("season")).alias("remainder"),
        (F.col("value") - F.col("season")).alias("seasadj"), "weight",
    )


def loess(panel: DataFrame, span: int = 13) -> DataFrame:
    """``id, date, value, smooth``: local linear regression of each series over its ``span`` nearest rows; rows without a value weigh nothing."""

    def one_series(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        y = rows["value"].to_numpy(dtype=float)
        known = ~np.isnan(y)
        return rows.assign(smooth=local_lines(np.where(known, y, 0.0), known.astype(float), span))

    series = spread(panel.select("id", "date", F.col("value").cast("double").alias("value")), "id")
    schema = f"id {dict(series.dtypes)['id']}, date date, value double, smooth double"
    return series.groupBy("id").applyInPandas(one_series, schema)


def decomposed_forecast(
    train: DataFrame,
    horizon: int,
    ahead: Callable[[DataFrame], DataFrame],
    freq: Freq = MONTH,
    season: int | None = None,
    model_id: str = "stl_smoothing",
    **form,
) -> DataFrame:
    """Forecasts of the seasonally adjusted series with the last season repeated on top.

    ``ahead`` turns the adjusted panel into ``id, step, date, prediction``. Series too short for a season are left out.
    """
    m = season or freq.season
    parts = materialize(stl(train, freq, season, **form).filter("season is not null"), "stl_parts")
    paths = ahead(parts.select("id", "date", F.col("seasadj").alias("value")))
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("date")))
    last = parts.select("id", "season", newest.alias("_back")).filter(F.col("_back") <= m)
    first = m - F.col("_back") + 1
    steps = F.when(first <= horizon, F.sequence(first, F.lit(horizon), F.lit(m)))
    turns = last.select("id", "season", F.explode(steps).alias("step"))
    both = paths.join(turns.withColumn("step", F.col("step").cast("bigint")), ["id", "step"])
    return both.select("id", F.lit(model_id).alias("model_id"), "step", "date", (F.col("prediction") + F.col("season")).alias("prediction"))
