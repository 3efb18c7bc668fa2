"""Decomposition by local regression against a plain numpy version."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import stl as L


def line(y, w, span, at):
    n = len(y)
    low = max(0, min(at - (span - 1) // 2, n - span))
    high = min(low + span - 1, n - 1)
    j = np.arange(low, high + 1)
    reach = max(at - low, high - at) + max(span - n, 0) // 2
    d = np.abs(j - at) / max(reach, 1e-9)
    near = np.where(d <= 0.001, 1.0, np.where(d > 0.999, 0.0, (1 - d**3) ** 3)) * w[j]
    if near.sum() <= 0:
        return np.nan
    near = near / near.sum()
    middle = (near * j).sum()
    scatter = (near * (j - middle) ** 2).sum()
    if np.sqrt(scatter) > 0.001 * (n - 1):
        near = near * ((at - middle) * (j - middle) / scatter + 1)
    return (near * y[j]).sum()


def smooth(y, w, span):
    out = np.array([line(y, w, span, i) for i in range(len(y))])
    return np.where(np.isnan(out), y, out)


def brute(y, m, span, inner, outer):
    n = len(y)
    trend, w = np.zeros(n), np.ones(n)
    t_span = L.trend_span(m, span)
    for turn in range(outer + 1):
        if turn:
            r = np.abs(y - trend - season)
            wide = 6 * np.median(r)
            if wide <= 1e-9 * np.abs(y).max():
                break
            w = np.where(r <= 0.001 * wide, 1.0, np.where(r > 0.999 * wide, 0.0, (1 - (r / wide) ** 2) ** 2))
        for _ in range(inner):
            c = np.zeros(n + 2 * m)
            for k in range(m):
                own, ow = (y - trend)[k::m], w[k::m]
                for j in range(-1, len(own) + 1):
                    if span is None:
                        v = (own * ow).sum() / ow.sum() if ow.sum() > 0 else own.mean()
                    else:
                        v = line(own, ow, span, j)
                        v = own[min(max(j, 0), len(own) - 1)] if np.isnan(v) else v
                    if (j + 1) * m + k < len(c):
                        c[(j + 1) * m + k] = v
            low = np.convolve(np.convolve(np.convolve(c, np.ones(m) / m, "valid"), np.ones(m) / m, "valid"), np.ones(3) / 3, "valid")
            season = c[m : m + n] - smooth(low, np.ones(n), L.odd_from(m))
            trend = smooth(y - season, w, t_span)
    if span is None:
        season = np.array([season[i % m :: m].mean() for i in range(n)])
    return trend, season, w


@pytest.fixture(scope="module")
def series():
    draw = np.random.default_rng(7)
    t = np.arange(65)
    plain = 10 + 0.2 * t + 4 * np.sin(2 * np.pi * t / 12) + 0.3 * draw.normal(size=65)
    spiked = plain.copy()
    spiked[[20, 41]] += 30
    return {"plain": plain, "spiked": spiked, "two": plain[:24], "odd": plain[:31]}


@pytest.mark.parametrize("form", [(None, 1, 0), (None, 2, 3), (7, 2, 0), (7, 1, 2)])
def test_equals_brute_force(series, make_panel, form):
    span, inner, outer = form
    panel = make_panel({k: v.tolist() for k, v in series.items()})
    got: dict = {}
    for r in L.stl(panel, season_span=span, inner=inner, outer=outer).orderBy("id", "date").collect():
        got.setdefault(r.id, []).append((r.trend, r.season, r.weight, r.remainder, r.seasadj))
    for k, y in series.items():
        trend, season, w = brute(y, 12, span, inner, outer)
        own = np.array(got[k])
        assert np.allclose(own[:, 0], trend) and np.allclose(own[:, 1], season) and np.allclose(own[:, 2], w)
        assert np.allclose(own[:, 3], y - trend - season) and np.allclose(own[:, 4], y - season)


def test_robust_form_ignores_spikes(series, make_panel):
    rows = L.stl(make_panel({k: series[k].tolist() for k in ("plain", "spiked")}))
    parts = {(r.id, r.date): r for r in rows.collect()}
    gap = [abs(r.trend - parts["plain", r.date].trend) for r in parts.values() if r.id == "spiked"]
    assert max(gap) < 1.0 and sorted(r.weight for r in parts.values() if r.id == "spiked")[:2] == [0.0, 0.0]


def test_edge_cases(spark, make_panel):
    panel = make_panel({"short": [1.0] * 23, "gap": {i: (None if i == 3 else 1.0) for i in range(30)}, "flat": [2.0] * 30})
    got = {r.id: r for r in L.stl(panel).groupBy("id").agg(F.count("trend").alias("n"), F.max("remainder").alias("r"), F.count("*").alias("rows")).collect()}
    assert (got["short"].n, got["gap"].n, got["flat"].n) == (0, 0, 30) and abs(got["flat"].r) < 1e-9 and got["gap"].rows == 30
    assert L.stl(panel.limit(0)).count() == 0


def test_loess(series, make_panel):
    panel = make_panel({"a": series["plain"].tolist(), "gap": {i: (None if i == 5 else float(i)) for i in range(30)}, "one": [4.0]})
    got: dict = {}
    for r in L.loess(panel, 9).orderBy("id", "date").collect():
        got.setdefault(r.id, []).append(r.smooth)
    assert np.allclose(got["a"], smooth(series["plain"], np.ones(65), 9))
    assert np.allclose(got["gap"], np.arange(30)) and got["one"] == [4.0]
