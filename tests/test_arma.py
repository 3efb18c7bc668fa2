"""Seasonal ARMA models: sums, statistics and orders against numpy, recovery, forecasts, advancing without a refit."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions.arrays import solve, stationary
from panelweave.functions.steps import MONTH
from panelweave.operators import arma as A
from tests.conftest import month


def simulated(n: int, ar=(), ma=(), constant=0.0, seed=1) -> np.ndarray:
    e = np.random.default_rng(seed).normal(size=n + 200)
    z = np.zeros(n + 200)
    for t in range(5, n + 200):
        z[t] = constant + sum(a * z[t - i] for i, a in enumerate(ar, 1)) + e[t] + sum(b * e[t - i] for i, b in enumerate(ma, 1))
    return z[200:]


def kpss(y: np.ndarray) -> float:
    e = y - y.mean()
    n, lags = len(y), int(4 * (len(y) / 100) ** 0.25)
    long_run = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / n / long_run)


def test_solve_and_stationary(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(30, 4))
    a, b = x.T @ x, x.T @ draw.normal(size=30)
    rows = [[[*map(float, line), float(v)] for line, v in zip(a, b)]]
    table = spark.createDataFrame([(rows[0], [0.5, 0.3], [1.2, -0.1], [0.0, 0.0, 0.9])], "m array<array<double>>, a array<double>, b array<double>, c array<double>")
    got = table.select(solve(F.col("m"), 4).alias("x"), stationary(F.col("a")).alias("a"), stationary(F.col("b")).alias("b"), stationary(F.col("c")).alias("c")).first()
    assert np.allclose(got.x, np.linalg.solve(a, b)) and (got.a, got.b, got.c) == (True, False, True)


def test_unit_root_statistic(spark):
    walks = {"noise": simulated(80), "walk": np.cumsum(simulated(80, seed=2)), "short": simulated(5, seed=4)}
    table = spark.createDataFrame([(k, v.tolist()) for k, v in walks.items()], "id string, y array<double>")
    got = {r.id: r.s for r in table.select("id", A.level_statistic(F.col("y")).alias("s")).collect()}
    assert all(abs(got[k] - kpss(v)) < 1e-9 for k, v in walks.items())
    assert got["noise"] < A.LEVEL_5 < got["walk"]


@pytest.fixture(scope="module")
def models(spark, make_panel):
    t = np.arange(240)
    season = 5 * np.sin(2 * np.pi * t / 12)
    series = {
        "ar": 10 + simulated(240, ar=(0.7,), seed=5),
        "ma": simulated(240, ma=(0.8,), seed=6),
        "arma": simulated(240, ar=(0.6,), ma=(0.5,), seed=7),
        "walk": np.cumsum(simulated(240, seed=8)) + 100,
        "seasonal": season + 0.3 * simulated(240, seed=9) + 50,
        "short": np.arange(6.0),
        "flat": np.full(60, 3.0),
    }
    panel = make_panel({k: v.tolist() for k, v in series.items()} | {"gap": {i: (None if i == 7 else float(i)) for i in range(60)}})
    return series, panel, A.arma_models(panel).persist()


def test_recovery(models):
    _, _, fitted = models
    rows = {r.id: r for r in fitted.collect()}
    assert {k for k, r in rows.items() if r.status == "error"} == {"short", "gap"}
    assert "missing" in rows["gap"].error and "too few" in rows["short"].error and rows["gap"].coef is None
    assert (rows["walk"].plain, rows["ar"].plain, rows["seasonal"].seasonal, rows["ar"].seasonal) == (1, 0, 1, 0)
    assert abs(rows["ar"].coef[1] - 0.7) < 0.15 and rows["ar"].variant.startswith("(1,")
    assert abs(rows["ma"].coef[5] - 0.8) < 0.2 or "(0,1)" not in rows["ma"].variant
    assert 0.7 < rows["arma"].sigma2 < 1.3 and 0.7 < rows["ma"].sigma2 < 1.3


def by_hand(row, m: int, h: int) -> list[float]:
    ys, zs, es, out = list(row.ys), list(row.zs), list(row.es), []
    for _ in range(h):
        known = [1.0, zs[0], zs[1], zs[2], zs[m - 1] if len(zs) >= m else 0.0, es[0], es[1], es[m - 1] if len(es) >= m else 0.0]
        z = sum(a * b for a, b in zip(row.coef, known))
        y = z + sum(w * v for w, v in zip(row.carry, ys))
        ys, zs, es = [y, *ys], [z, *zs], [0.0, *es]
        out.append(y)
    return out


def test_forecast_is_the_recursion(models):
    _, _, fitted = models
    rows = {r.id: r for r in fitted.filter("status = 'ok'").collect()}
    got: dict = {}
    for r in A.arma_forecast(fitted, 18).orderBy("id", "step").collect():
        got.setdefault(r.id, []).append(r.prediction)
    assert set(got) == set(rows)
    for k, path in got.items():
        assert np.allclose(path, by_hand(rows[k], 12, 18)) and all(map(math.isfinite, path))
    assert np.ptp(got["flat"]) < 1e-9 and abs(got["flat"][0] - 3) < 1e-9
    ahead = 50 + 5 * np.sin(2 * np.pi * np.arange(240, 258) / 12)
    assert np.abs(np.array(got["seasonal"]) - ahead).max() < 1.5


def test_advance_needs_no_refit(spark, models, make_panel):
    """State after new rows equals the state of the whole series under the same coefficients."""
    series, _, fitted = models
    ids = ["ar", "arma", "walk", "seasonal"]
    cut = make_panel({k: series[k][:200].tolist() for k in ids})
    first = A.arma_models(cut).persist()
    rest = spark.createDataFrame([(k, month(i), float(series[k][i])) for k in ids for i in range(200, 240)], "id string, date date, value double")
    moved = {r.id: r for r in A.advance(first, rest).collect()}
    for r in first.collect():
        y, z = series[r.id], series[r.id]
        for lag in [12] * r.seasonal + [1] * r.plain:
            z = z[lag:] - z[:-lag]
        e = np.zeros(len(z))
        for t in range(12, len(z)):
            known = [1, z[t - 1], z[t - 2], z[t - 3], z[t - 12], e[t - 1], e[t - 2], e[t - 12]]
            e[t] = z[t] - np.dot(r.coef, known)
        after = moved[r.id]
        assert after.last_date == month(239) and np.allclose(after.ys, y[::-1][: len(r.carry)])
        assert np.allclose(after.zs, z[::-1][:12]) and np.allclose(after.es, e[::-1][:12]) and after.coef == r.coef
    gap = spark.createDataFrame([("ar", month(202), 11.0), ("new", month(202), 1.0), ("ar", month(150), 1.0)], "id string, date date, value double")
    again = {r.id: r for r in A.advance(first, gap).collect()}
    assert again["ar"].last_date == month(202) and again["ar"].ys == [] and abs(again["ar"].zs[0] - 11.0) < 1e-12
    assert again["walk"].last_date == month(199) and len(again) == 4
    assert A.arma_models(cut.limit(0)).count() == 0
