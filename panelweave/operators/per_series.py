"""One model per series, fitted inside grouped tasks.

Spark groups the panel by ``id``, one array per series (bounded by the calendar), and
hands a task a few hundred series at a time; the small numpy fits below are all that runs
on them. Smoothing steps through series of one length side by side. Every candidate of a
series is fitted in the same call, so the series travels once. A fit that fails becomes a
row with ``status = 'error'``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.steps import MONTH, Freq
from panelweave.session import spread

# The fits travel to the workers with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALPHAS = tuple(round(0.05 * i, 2) for i in range(1, 20))
TREND_RATES = (0.05, 0.1, 0.2, 0.4)
SEASON_RATES = (0.05, 0.1, 0.2, 0.4)
DAMPING = (0.9, 0.98)
MAX_ORDER = 6
HARMONICS = 4
SERIES_AT_ONCE = 256  # series a task fits before it hands their rows on
CELLS_AT_ONCE = 8192  # (series, grid point) that stay in the processor's cache

FORECAST_SCHEMA = (
    "id string, model_id string, variant string, step bigint, date date, prediction double, "
    "params string, status string, error string"
)


@dataclass(frozen=True)
class Fit:
    """In-sample one-step values (NaN where none), the future path and how it was made."""

    fitted: np.ndarray
    path: np.ndarray
    variant: str
    params: str


def seasonal_means(y: np.ndarray, m: int) -> np.ndarray:
    """Centred seasonal means around a moving average, by position modulo m."""
    if len(y) < 2 * m:
        raise ValueError(f"needs {2 * m} points, has {len(y)}")
    kernel = np.ones(m + 1 if m % 2 == 0 else m)
    if m % 2 == 0:
        kernel[[0, -1]] = 0.5
    trend = np.convolve(y, kernel / kernel.sum(), mode="valid")
    offset = (len(y) - len(trend)) // 2
    rest = y[offset : offset + len(trend)] - trend
    spot = (np.arange(len(rest)) + offset) % m
    means = np.array([rest[spot == i].mean() for i in range(m)])
    return means - means.mean()


def smooth_grid(y: np.ndarray, h: int, m: int, trend: str, season: str) -> tuple[float, Fit]:
    """Best smoothing of one form: every grid point runs through the series as one vector."""
    return smooth_grids(y[None], h, m, trend, season)[0]


def smooth_grids(ys: np.ndarray, h: int, m: int, trend: str, season: str) -> list[tuple[float, Fit]]:
    """:func:`smooth_grid` of several series of one length, ``CELLS_AT_ONCE`` cells (series, grid point) at a time."""
    beta = TREND_RATES if trend != "N" else (0.0,)
    gamma = SEASON_RATES if season != "N" else (0.0,)
    phi = DAMPING if trend == "Ad" else ((1.0,) if trend == "A" else (0.0,))
    grid = tuple(np.array(v) for v in zip(*product(ALPHAS, beta, gamma, phi)))
    some = max(1, CELLS_AT_ONCE // len(grid[0]))
    return [found for at in range(0, len(ys), some) for found in _smoothed(ys[at : at + some], h, m, trend, season, grid)]


def _smoothed(ys: np.ndarray, h: int, m: int, trend: str, season: str, grid: tuple[np.ndarray, ...]) -> list[tuple[float, Fit]]:
    length, times = ys.shape[1], season == "M"
    if season != "N" and length < 2 * m:
        raise ValueError(f"needs {2 * m} points, has {length}")
    if times and (ys <= 0).any():
        raise ValueError("multiplicative season needs positive values")
    sse = _stepped(ys, m, trend, season, grid)[0]
    best = np.argmin(sse, axis=1)
    fitted: list[np.ndarray] = []
    _, level, slope, cycle = _stepped(ys, m, trend, season, tuple(v[best][:, None] for v in grid), fitted)
    start, inner = length - len(fitted), np.array(fitted).reshape(len(fitted), len(ys))
    n_par = 2 + (trend != "N") * 2 + (trend == "Ad") + (season != "N") * (1 + m)
    n, out = length - start, []
    for at, i in enumerate(best):
        a, b, g, p = (v[i] for v in grid)
        reach = np.cumsum(p ** np.arange(1, h + 1)) * slope[at, 0]
        path = level[at, 0] + reach
        if season != "N":
            turn = cycle[(length + np.arange(h)) % m, at, 0]
            path = path * turn if times else path + turn
        score = n * np.log(max(sse[at, i], 1e-12) / n) + 2 * n_par
        known = np.concatenate([np.full(start, np.nan), inner[:, at]])
        out.append((score, Fit(known, path, f"{trend},{season}", f"alpha={a} beta={b} gamma={g} phi={p}")))
    return out


def _stepped(
    ys: np.ndarray, m: int, trend: str, season: str, rates: tuple[np.ndarray, ...], fitted: list[np.ndarray] | None = None
) -> tuple[np.ndarray, ...]:
    """Squared error and end state of every (series, rates); ``fitted`` takes what was expected at each step."""
    a, b, g, p = rates
    count, k, length, times = len(ys), a.shape[-1], ys.shape[1], season == "M"
    each = lambda values: np.repeat(np.array(values, float)[:, None], k, axis=1)
    if season == "N":
        start, cycle, period = 1, np.zeros((1, 1, 1)), 1
        level, slope = each(ys[:, 0]), np.zeros((count, k))
    else:
        start, period = m, m
        first = [y[:m].mean() for y in ys]
        level = each(first)
        slope = each([(y[m : 2 * m].mean() - mean) / m if trend != "N" else 0.0 for y, mean in zip(ys, first)])
        base = np.array([y[:m] / mean if times else y[:m] - mean for y, mean in zip(ys, first)])
        cycle = np.repeat(base.T[:, :, None], k, axis=2)
    keep_level, keep_slope, keep_season = 1 - a, (1 - b) * p, 1 - g
    sse = np.zeros((count, k))
    for t in range(start, length):
        now = ys[:, t, None]
        s = cycle[t % period] if season != "N" else (1.0 if times else 0.0)
        ahead = level + p * slope
        guess = ahead * s if times else ahead + s
        if fitted is not None:
            fitted.append(guess)
        sse += (now - guess) ** 2
        fresh = a * (now / s if times else now - s) + keep_level * ahead
        slope = b * (fresh - level) + keep_slope * slope
        if season != "N":
            cycle[t % period] = g * (now / ahead if times else now - ahead) + keep_season * s
        level = fresh
    return sse, level, slope, cycle


def _best_form(ys: np.ndarray, h: int, m: int, forms: Sequence[tuple[str, str]]) -> list[Fit]:
    """Per series the form of the lowest criterion, the first of equal ones."""
    tried = [smooth_grids(ys, h, m, trend, season) for trend, season in forms]
    return [min(own, key=lambda r: r[0])[1] for own in zip(*tried)]


def exp_smoothings(ys: np.ndarray, h: int, m: int) -> list[Fit]:
    """Best of level, trend, damped-trend and seasonal forms by an information criterion; series of one length."""
    out: list[Fit | None] = [None] * len(ys)
    positive = (ys > 0).all(axis=1)
    for times in (False, True):
        own = np.nonzero(positive == times)[0]
        seasons = ["N"]
        if ys.shape[1] >= 2 * m:
            seasons += ["A"] + (["M"] if times else [])
        if len(own):
            for at, fit in zip(own, _best_form(ys[own], h, m, [(t, s) for t in ("N", "A", "Ad") for s in seasons])):
                out[at] = fit
    return out


def fit_exp_smoothing(y: np.ndarray, h: int, m: int) -> Fit:
    return exp_smoothings(y[None], h, m)[0]


def fit_level_smoothing(y: np.ndarray, h: int, m: int) -> Fit:
    """Level only."""
    return smooth_grid(y, h, m, "N", "N")[1]


def trend_smoothings(ys: np.ndarray, h: int, m: int) -> list[Fit]:
    """Best of level, trend and damped trend, for series without a season."""
    return _best_form(ys, h, m, [(t, "N") for t in ("N", "A", "Ad")])


def fit_trend_smoothing(y: np.ndarray, h: int, m: int) -> Fit:
    return trend_smoothings(y[None], h, m)[0]


def decomp_smoothings(ys: np.ndarray, h: int, m: int) -> list[Fit]:
    """Smooth the series without their seasonal means, add them back."""
    n = ys.shape[1]
    spot = np.arange(n + h) % m
    seasons = [seasonal_means(y, m) for y in ys]
    inner = trend_smoothings(np.array([y - season[spot[:n]] for y, season in zip(ys, seasons)]), h, m)
    return [
        Fit(fit.fitted + season[spot[:n]], fit.path + season[spot[n:]], "means," + fit.variant, fit.params)
        for fit, season in zip(inner, seasons)
    ]


def fit_decomp_smoothing(y: np.ndarray, h: int, m: int) -> Fit:
    return decomp_smoothings(y[None], h, m)[0]


def fit_harmonic(y: np.ndarray, h: int, m: int) -> Fit:
    """Linear trend plus sine and cosine pairs, least squares."""
    t = np.arange(len(y) + h)
    k = min(HARMONICS, m // 2, max(0, (len(y) - 3) // 2))
    waves = [f(2 * np.pi * j * t / m) for j in range(1, k + 1) for f in (np.sin, np.cos)]
    x = np.column_stack([np.ones_like(t, dtype=float), t / len(y), *waves])
    coef, *_ = np.linalg.lstsq(x[: len(y)], y, rcond=None)
    line = x @ coef
    return Fit(line[: len(y)], line[len(y) :], f"K={k}", " ".join(f"{c:.6g}" for c in coef))


def segment_costs(y: np.ndarray) -> np.ndarray:
    """Squared error of a straight line through rows i to j - 1, for all i < j, from prefix sums."""
    n = len(y)
    t = np.arange(n) - (n - 1) / 2
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (np.ones(n), t, y, t * t, t * y, y * y)]
    c, st, sy, stt, sty, syy = (s[None, :] - s[:, None] for s in sums)
    with np.errstate(divide="ignore", invalid="ignore"):
        vt, vy, cov = stt - st * st / c, syy - sy * sy / c, sty - st * sy / c
        return np.maximum(vy - np.where(vt > 1e-9, cov * cov / vt, 0.0), 0.0)


def change_points(y: np.ndarray, least: int, penalty: float) -> list[int]:
    """First rows of the later segments of the cheapest cut into straight lines: dynamic programming over the last cut."""
    n, cost = len(y), segment_costs(y)
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for j in range(least, n + 1):
        starts = np.arange(0, j - least + 1)
        total = best[starts] + cost[starts, j] + penalty
        last[j] = starts[np.argmin(total)]
        best[j] = total.min()
    cuts, j = [], n
    while last[j] > 0:
        j = last[j]
        cuts.append(int(j))
    return cuts[::-1]


def fit_piecewise(y: np.ndarray, h: int, m: int) -> Fit:
    """A line that bends where the series does, with sine and cosine pairs; the last slope goes on."""
    n = len(y)
    adjusted = y - seasonal_means(y, m)[np.arange(n) % m] if n >= 2 * m else y
    least = max(6, m // 2)
    steps = np.diff(adjusted)
    noise = np.median(np.abs(steps - np.median(steps))) / 0.6745 / np.sqrt(2) if n > 2 else 0.0
    cuts = change_points(adjusted, least, max(4 * noise**2 * np.log(n), 1e-12)) if n >= 2 * least else []
    t = np.arange(n + h)
    k = min(HARMONICS, m // 2, max(0, (n - 3 - len(cuts)) // 2))
    waves = [f(2 * np.pi * j * t / m) for j in range(1, k + 1) for f in (np.sin, np.cos)]
    bends = [np.maximum(t - c, 0) / n for c in cuts]
    x = np.column_stack([np.ones_like(t, dtype=float), t / n, *bends, *waves])
    coef, *_ = np.linalg.lstsq(x[:n], y, rcond=None)
    line = x @ coef
    return Fit(line[:n], line[n:], f"bends={len(cuts)},K={k}", " ".join(map(str, cuts)))


def fit_autoregression(y: np.ndarray, h: int, m: int) -> Fit:
    """AR(p) with intercept on the seasonally (else once) differenced series; p by corrected AIC."""
    d = m if len(y) >= 3 * m else 1
    z = y[d:] - y[:-d]
    top = min(MAX_ORDER, (len(z) - 4) // 2)
    if top < 0:
        raise ValueError(f"needs {d + 4} points, has {len(y)}")
    best = None
    target = z[top:]
    n = len(target)
    for p in range(top + 1):
        x = np.column_stack([np.ones(n)] + [z[top - j : len(z) - j] for j in range(1, p + 1)])
        coef, *_ = np.linalg.lstsq(x, target, rcond=None)
        rss = float(((target - x @ coef) ** 2).sum())
        k = p + 2
        if n - k - 1 <= 0:
            continue
        score = n * np.log(max(rss, 1e-12) / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        if best is None or score < best[0]:
            best = (score, p, coef, x @ coef)
    if best is None:
        raise ValueError("too few points for any order")
    _, p, coef, inner = best
    fitted = np.full(len(y), np.nan)
    fitted[d + top :] = inner + y[top : len(y) - d]
    zs, ys = list(z), list(y)
    for _ in range(h):
        step = coef[0] + sum(coef[j] * zs[-j] for j in range(1, p + 1))
        zs.append(step)
        ys.append(ys[-d] + step)
    return Fit(fitted, np.array(ys[len(y) :]), f"AR({p}),D={d}", " ".join(f"{c:.6g}" for c in coef))


def fit_seasonal_naive(y: np.ndarray, h: int, m: int) -> Fit:
    """Last season repeated."""
    if len(y) < m:
        raise ValueError(f"needs {m} points, has {len(y)}")
    fitted = np.full(len(y), np.nan)
    fitted[m:] = y[:-m]
    return Fit(fitted, y[len(y) - m + np.arange(h) % m], f"[{m}]", "")


CANDIDATES: dict[str, Callable[[np.ndarray, int, int], Fit]] = {
    "seasonal_naive": fit_seasonal_naive,
    "exp_smoothing": fit_exp_smoothing,
    "trend_smoothing": fit_trend_smoothing,
    "decomp_smoothing": fit_decomp_smoothing,
    "harmonic": fit_harmonic,
    "piecewise": fit_piecewise,
    "autoregression": fit_autoregression,
}
# Candidates that fit several series of one length at once, to the same numbers.
TOGETHER: dict[str, Callable[[np.ndarray, int, int], list[Fit]]] = {
    "exp_smoothing": exp_smoothings,
    "trend_smoothing": trend_smoothings,
    "decomp_smoothing": decomp_smoothings,
}
LOCAL_CANDIDATES = ("seasonal_naive", "exp_smoothing", "autoregression")


FITTED_SCHEMA = (
    "id string, last_date date, model_id string, variant string, step bigint, prediction double, "
    "params string, status string, error string"
)


def _attempts(fit: Callable, together: Callable | None, ys: list[np.ndarray], h: int, m: int) -> list[Fit | Exception]:
    """The fit of every series, or what went wrong with it."""

    def one(y: np.ndarray) -> Fit | Exception:
        try:
            if np.isnan(y).any():
                raise ValueError("series has missing values")
            return fit(y, h, m)
        except Exception as problem:  # one failed fit must not fail the job
            return problem

    out: list[Fit | Exception | None] = [None] * len(ys)
    alike: dict[int, list[int]] = {}
    for at, y in enumerate(ys):
        if together is not None and not np.isnan(y).any():
            alike.setdefault(len(y), []).append(at)
    for places in alike.values():
        try:
            for at, done in zip(places, together(np.array([ys[at] for at in places]), h, m)):
                out[at] = done
        except Exception:  # some of them cannot be fitted: each on its own tells which
            continue
    return [one(y) if done is None else done for y, done in zip(ys, out)]


def _fitted(fits: dict[str, Callable], together: dict[str, Callable], horizon: int, m: int, include_fitted: bool) -> Callable:
    """Rows of ``FITTED_SCHEMA`` for series that come as arrays."""

    def rows_of(name: str, done: Fit | Exception, n: int) -> tuple:
        if isinstance(done, Exception):
            return [0], [np.nan], name, None, None, "error", f"{type(done).__name__}: {done}"
        steps, values = np.arange(1, horizon + 1), done.path
        if include_fitted:
            steps, values = np.arange(1 - n, horizon + 1), np.concatenate([done.fitted, values])
        return steps, values, name, done.variant, done.params, "ok", None

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        ys = [np.array([np.nan if v is None else v for v in y], float) for y in batch.column("y").to_pylist()]
        chosen = batch.column("chosen").to_pylist()
        found: list[list[tuple]] = [[] for _ in ys]
        for name, fit in fits.items():
            own = [at for at, only in enumerate(chosen) if only is None or only == name]
            for at, done in zip(own, _attempts(fit, together.get(name), [ys[at] for at in own], horizon, m)):
                found[at].append(rows_of(name, done, len(ys[at])))
        lines = [(at, *line) for at, own in enumerate(found) for line in own]
        lengths = np.array([len(line[1]) for line in lines], int)
        places = pa.array(np.repeat(np.arange(len(lines)), lengths))
        series = pa.array(np.array([line[0] for line in lines], int))
        text = lambda k: pa.array([line[k] for line in lines], pa.string()).take(places)
        numbers = lambda k, kind: pa.array(np.concatenate([np.empty(0), *[line[k] for line in lines]]).astype(kind))
        ids, dates = (batch.column(c).take(series).take(places) for c in ("id", "last_date"))
        columns = [ids, dates, text(3), text(4), numbers(1, np.int64), numbers(2, float), text(5), text(6), text(7)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FITTED_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SERIES_AT_ONCE):
                yield part(batch.slice(at, SERIES_AT_ONCE))

    return run


def fit_per_series(
    train: DataFrame,
    horizon: int,
    candidates: Sequence[str] = LOCAL_CANDIDATES,
    freq: Freq = MONTH,
    season: int | None = None,
    include_fitted: bool = False,
    only: DataFrame | None = None,
    by_id: bool = False,
) -> DataFrame:
    """Forecasts of every candidate for every series, failures as rows.

    ``include_fitted`` adds the in-sample one-step values as rows with step <= 0.
    ``only`` (``id, model_id``) restricts each series to its chosen model: the
    refit after selection. ``by_id`` says the rows already lie bucketed by id.
    """
    m = season or freq.season
    fits = {name: CANDIDATES[name] for name in candidates}
    series = train.select("id", "date", "value")
    if only is not None:
        known = only.filter(F.col("model_id").isin(*fits)).select("id", F.col("model_id").alias("chosen"))
        series = series.join(known, "id")
    else:
        series = series.withColumn("chosen", F.lit(None).cast("string"))
    undated = F.col("date").isNull().alias("undated")  # such rows come last
    points = F.sort_array(F.collect_list(F.struct(undated, "date", F.col("value").cast("double").alias("value"))))
    grouped = (series if by_id else spread(series, "id")).groupBy("id").agg(points.alias("points"), F.first("chosen").alias("chosen"))
    arrays = grouped.select(
        "id", F.element_at("points", -1)["date"].alias("last_date"), "chosen", F.transform("points", lambda p: p["value"]).alias("y")
    )
    fitted = arrays.mapInArrow(_fitted(fits, TOGETHER, horizon, m, include_fitted), FITTED_SCHEMA)
    date: Column = F.when(F.col("status") == "ok", freq.add(F.col("last_date"), F.col("step")))
    return fitted.select(
        "id", "model_id", "variant", "step", date.alias("date"),
        F.when(~F.isnan("prediction"), F.col("prediction")).alias("prediction"), "params", "status", "error",
    )


def ok_forecasts(fits: DataFrame) -> DataFrame:
    """The future rows of successful fits."""
    return fits.filter((F.col("status") == "ok") & (F.col("step") > 0))


def fit_errors(fits: DataFrame) -> DataFrame:
    """One row per failed (id, model)."""
    return fits.filter(F.col("status") == "error").select("id", "model_id", "error")


def level_smoothing(train: DataFrame, horizon: int, freq: Freq = MONTH, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Level-only smoothing without Python: a fold over each series for each rate, best one kept.

    Squared one-step errors start at the second point; ties take the smaller rate.
    """
    values = F.transform(F.sort_array(F.collect_list(F.struct("date", "value"))), lambda p: p["value"])
    series = spread(train, "id").groupBy("id").agg(values.alias("values"), F.max("date").alias("_last"))
    rest = F.slice("values", F.lit(2), F.greatest(F.size("values") - 1, F.lit(0)))
    start = F.struct(F.lit(0.0).alias("sse"), F.get("values", F.lit(0)).alias("level"))

    def run(rate: Column) -> Column:
        def advance(state: Column, y: Column) -> Column:
            miss = y - state["level"]
            return F.struct(
                (state["sse"] + miss * miss).alias("sse"),
                (rate * y + (F.lit(1.0) - rate) * state["level"]).alias("level"),
            )

        end = F.aggregate(rest, start, advance)
        return F.struct(end["sse"].alias("sse"), rate.alias("alpha"), end["level"].alias("level"))

    best = F.array_min(F.transform(F.array(*[F.lit(float(a)) for a in alphas]), run))
    return (
        series.withColumn("_best", best)
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(
            "id",
            F.lit("level_smoothing").alias("model_id"),
            F.col("step").cast("bigint").alias("step"),
            freq.add(F.col("_last"), F.col("step")).alias("date"),
            F.col("_best.level").alias("prediction"),
            F.col("_best.alpha").alias("alpha"),
            F.col("_best.sse").alias("sse"),
        )
    )
