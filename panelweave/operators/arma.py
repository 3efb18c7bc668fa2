"""Seasonal ARMA models, one per series, without Python workers.

A series travels once, as an array in its row; everything after that is projections.

1. Differences: a seasonal one where the season is strong (share of the variance around the trend
   above ``STRONG``), then plain ones, up to two, while a unit-root statistic
   (KPSS, against a level) stays above its 5 % value.
2. A long autoregression by least squares stands in for the unseen shocks.
3. The normal equations of the differenced series on its lags and the lags of the shocks are summed
   once; every candidate order (p, q and one seasonal term of each kind) solves its part of them.
   The best corrected AIC whose autoregressive and moving-average parts both die out is kept.
4. The kept model is a row: coefficients, and the newest values, differences and shocks, newest
   first. Forecasts are a fold over that row, and so is :func:`advance`, which takes new
   observations into it without a new fit.

A series with gaps or too few points for any order is a row with ``status = 'error'``.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.arrays import (
    bind, dot, doubles, lagged_difference, mean, normal_equations, outer_sums, restricted, solve, stationary, total, upto,
)
from panelweave.functions.steps import MONTH, Freq
from panelweave.operators.diagnostics import decompose
from panelweave.session import materialize, spread

STRONG = 0.64  # seasonal strength from which a seasonal difference is taken
LEVEL_5 = 0.463  # fixed value: KPSS statistic of a level at 5 %
MAX_P, MAX_Q = 3, 2
LONG = 6  # lags of the first autoregression
LEAST_ROWS = 8


def season_strength(panel: DataFrame, freq: Freq = MONTH, season: int | None = None) -> DataFrame:
    """``(id, strength)``: 1 - var(remainder) / var(season + remainder), not below 0; null without a full season."""
    parts = decompose(panel, freq, season).filter("remainder is not null")
    share = F.try_divide(F.var_pop("remainder"), F.var_pop(F.col("season") + F.col("remainder")))
    return parts.groupBy("id").agg(F.greatest(F.lit(0.0), F.lit(1.0) - share).alias("strength"))


def level_statistic(values: Column) -> Column:
    """KPSS: squared partial sums around the mean over the long-run variance (Bartlett weights)."""

    def of(y: Column) -> Column:
        n = F.size(y)
        lags = F.floor(4 * F.pow(n / F.lit(100.0), F.lit(0.25))).cast("int")

        def statistic(e: Column) -> Column:
            run = F.aggregate(
                e,
                F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss")),
                lambda acc, v: F.struct((acc["s"] + v).alias("s"), (acc["ss"] + (acc["s"] + v) * (acc["s"] + v)).alias("ss")),
            )["ss"]
            shared = lambda k: dot(F.slice(e, k + 1, F.greatest(n - k, F.lit(0))), e)
            weighted = F.transform(upto(F.lit(1), F.least(lags, n - 1)), lambda k: (1 - k / (lags + F.lit(1.0))) * shared(k))
            long_run = dot(e, e) + 2 * total(weighted)
            return F.try_divide(run, n * long_run)

        return bind(mean(y), lambda m: bind(F.transform(y, lambda v: v - m), statistic))

    return F.when(F.size(values) > 2, bind(values, of))


def series_arrays(train: DataFrame, freq: Freq = MONTH, season: int | None = None) -> DataFrame:
    """``(id, last_date, y, strength)``, one row per series; its rows are bounded by the calendar."""
    ordered = F.sort_array(F.collect_list(F.struct("date", "value")))
    arrays = spread(train.select("id", "date", "value"), "id").groupBy("id").agg(
        F.max("date").alias("last_date"), F.transform(ordered, lambda p: p["value"]).alias("y")
    )
    return arrays.join(season_strength(train, freq, season), "id", "left")


def differencing(series: DataFrame, m: int) -> DataFrame:
    """Adds ``seasonal`` and ``plain`` (how many differences of each kind) and the differenced series ``z``."""
    strong = (F.coalesce("strength", F.lit(0.0)) > STRONG) & (F.size("y") >= 3 * m)
    unstable = lambda z: F.coalesce(level_statistic(z) > LEVEL_5, F.lit(False))
    as_is = lambda z, k: F.struct(F.lit(k).alias("plain"), z.alias("z"))

    def plain(z: Column) -> Column:
        twice = lambda z1: F.when(unstable(z1), as_is(lagged_difference(z1, 1), 2)).otherwise(as_is(z1, 1))
        return F.when(unstable(z), bind(lagged_difference(z, 1), twice)).otherwise(as_is(z, 0))

    seasonal = series.withColumn("seasonal", strong.cast("int"))
    z0 = F.when(F.col("seasonal") == 1, lagged_difference(F.col("y"), m)).otherwise(F.col("y"))
    return seasonal.withColumn("_d", bind(z0, plain)).select("*", "_d.plain", "_d.z").drop("_d")


def _carry(m: int) -> Column:
    """Weights of the newest values in the next one, for a next difference of zero."""
    cases = None
    for seasonal, plain in product((0, 1), (0, 1, 2)):
        poly = [1.0]
        for step in [m] * seasonal + [1] * plain:
            poly = [a - b for a, b in zip(poly + [0.0] * step, [0.0] * step + poly)]
        hit = (F.col("seasonal") == seasonal) & (F.col("plain") == plain)
        weights = doubles([-c for c in poly[1:]])
        cases = F.when(hit, weights) if cases is None else cases.when(hit, weights)
    return cases


def _lags(values: Column, t: Column, lags) -> list[Column]:
    return [F.coalesce(F.get(values, t - k), F.lit(0.0)) for k in lags]


def _candidates(m: int) -> list[tuple[str, int, int, list[int]]]:
    """Name, whether seasonal, number of coefficients and which of [1, z lags, z season, e lags, e season] are used."""
    out = []
    for p, q, sp, sq in product(range(MAX_P + 1), range(MAX_Q + 1), (0, 1), (0, 1)):
        mask = [1] + [int(i < p) for i in range(MAX_P)] + [sp] + [int(i < q) for i in range(MAX_Q)] + [sq]
        out.append((f"({p},{q})({sp},{sq})[{m}]", sp + sq, 1 + p + q + sp + sq, mask))
    return out


def lag_products(train: DataFrame, lags: tuple[int, ...], seasonal: int = 0) -> DataFrame:
    """``id, row, col, n, total``: sums of products of [1, lags of z, z] over the rows that have all lags.

    z is the series, after one difference at lag ``seasonal`` if that is not 0.
    """
    z = F.col("z")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("date", "value"))), lambda p: p["value"].cast("double"))
    series = spread(train.select("id", "date", "value"), "id").groupBy("id").agg(ordered.alias("y"))
    series = series.select("id", (lagged_difference(F.col("y"), seasonal) if seasonal else F.col("y")).alias("z"))
    width = len(lags) + 2
    row = lambda t: F.array(F.lit(1.0), *[F.get(z, t - k) for k in lags], F.get(z, t))
    rows = upto(F.lit(max(lags)), F.size(z) - 1)
    summed = series.select("id", F.size(rows).cast("bigint").alias("n"), F.posexplode(outer_sums(rows, row, width)).alias("_i", "total"))
    place = F.col("_i").cast("bigint")
    return summed.select("id", F.floor(place / width).alias("row"), (place % width).alias("col"), "n", "total")


def shock_equations(series: DataFrame, m: int) -> DataFrame:
    """Adds ``n_rows`` and ``sums``: the outer sums of [1, z lags, z season, shock lags, shock season, z]."""
    z, n = F.col("z"), F.size("z")
    width = LONG + 3
    far = F.when(n > 3 * m, F.lit(m)).otherwise(F.lit(LONG))
    seasonal_lag = lambda t: F.when(n > 3 * m, F.coalesce(F.get(z, t - m), F.lit(0.0))).otherwise(F.lit(0.0))
    long_row = lambda t: F.array(F.lit(1.0), *_lags(z, t, range(1, LONG + 1)), seasonal_lag(t), F.get(z, t))
    first = F.greatest(far, F.lit(LONG))
    used = F.array(*[F.lit(1)] * (LONG + 1), F.when(n > 3 * m, 1).otherwise(0))
    long_fit = solve(restricted(normal_equations(outer_sums(upto(first, n - 1), long_row, width), width), used), width - 1)
    fitted = series.withColumn("_long", long_fit)

    # Columns used inside a fold are bound: the planner may put their expression in their place.
    def shocks(coef: Column) -> Column:
        def shock(v: Column, t: Column) -> Column:
            known = F.slice(long_row(t), 1, LONG + 2)
            return F.when(t >= first, F.coalesce(v - dot(known, coef), F.lit(0.0))).otherwise(F.lit(0.0))

        return F.transform(z, shock)

    start = F.when(n > 3 * m, F.lit(m)).otherwise(F.lit(MAX_P))
    width = MAX_P + MAX_Q + 4

    def summed(e: Column) -> Column:
        def row(t: Column) -> Column:
            return F.array(
                F.lit(1.0), *_lags(z, t, range(1, MAX_P + 1)), seasonal_lag(t), *_lags(e, t, range(1, MAX_Q + 1)),
                F.when(n > 3 * m, F.coalesce(F.get(e, t - m), F.lit(0.0))).otherwise(F.lit(0.0)), F.get(z, t),
            )

        return outer_sums(upto(start, n - 1), row, width)

    fitted = fitted.withColumn("_e", bind(F.col("_long"), shocks))
    summed = fitted.withColumn("sums", bind(F.col("_e"), summed))
    return summed.withColumn("n_rows", F.greatest(n - start, F.lit(0))).drop("_long", "_e")


def arma_models(train: DataFrame, freq: Freq = MONTH, season: int | None = None) -> DataFrame:
    """One row per series: ``id, last_date, status, error, variant, seasonal, plain, aicc, sigma2, coef, carry, ys, zs, es``.

    ``coef`` holds [constant, z lags, z season, shock lags, shock season]; ``ys``, ``zs``, ``es`` the
    newest values, differences and shocks, newest first.
    """
    m = season or freq.season
    if m <= MAX_P:
        raise ValueError(f"a season has more than {MAX_P} periods")
    known = differencing(series_arrays(train, freq, season), m)
    summed = materialize(shock_equations(known, m), "arma_sums")
    width = MAX_P + MAX_Q + 4
    yy = F.get("sums", F.lit(width * width - 1))
    choices = F.array(
        *[F.struct(F.lit(v).alias("variant"), F.lit(s).alias("terms"), F.lit(k).alias("k"), F.array(*map(F.lit, mask)).alias("mask"))
          for v, s, k, mask in _candidates(m)]
    )
    n = F.col("n_rows").cast("double")
    may = lambda c: ((c["terms"] == 0) | (F.size("z") > 3 * m)) & (n - c["k"] - 2 > 0)
    # Two differences leave no constant: a straight line would bend.
    open_mask = lambda mask: F.when(F.col("seasonal") + F.col("plain") > 1, F.concat(F.array(F.lit(0)), F.slice(mask, 2, width))).otherwise(mask)

    def judged(equations: Column) -> Column:
        def one(c: Column) -> Column:
            def scored(coef: Column) -> Column:
                explained = dot(coef, F.transform(equations, lambda line: F.get(line, F.lit(width - 1))))
                rss = F.greatest(yy - explained, F.lit(1e-12))
                k = c["k"] + F.lit(1.0)
                aicc = n * F.log(rss / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
                sound = ~F.exists(coef, lambda v: v.isNull())
                return F.struct(
                    F.when(sound, aicc).alias("aicc"), c["k"].alias("k"), c["variant"].alias("variant"), (rss / n).alias("sigma2"), coef.alias("coef")
                )

            return bind(solve(restricted(equations, open_mask(c["mask"])), width - 1), scored)

        return F.array_sort(F.filter(F.transform(F.filter(choices, may), one), lambda r: r["aicc"].isNotNull()))

    def lag_polynomial(coef: Column, first: int, count: int, sign: float) -> Column:
        near = F.transform(F.slice(coef, first, count), lambda v: v * sign)
        gap = F.array_repeat(F.lit(0.0), m - count - 1)
        return F.concat(near, gap, F.array(F.get(coef, F.lit(first - 1 + count)) * sign))

    def sound(r: Column) -> Column:
        ar = lag_polynomial(r["coef"], 2, MAX_P, 1.0)
        ma = lag_polynomial(r["coef"], MAX_P + 3, MAX_Q, -1.0)
        return stationary(ar) & stationary(ma)

    ranked = summed.withColumn("_ranked", bind(normal_equations(F.col("sums"), width), judged)).drop("sums")
    # Lazily: only as many candidates are examined as it takes.
    kind = "struct<aicc:double,k:int,variant:string,sigma2:double,coef:array<double>>"
    first_sound = F.aggregate(
        "_ranked", F.lit(None).cast(kind), lambda best, r: F.when(best.isNotNull(), best).otherwise(F.when(sound(r), r))
    )
    gaps = F.exists("y", lambda v: v.isNull() | F.isnan(v))
    chosen = materialize(ranked.withColumn("_best", first_sound).drop("_ranked"), "arma_choice")
    fine = F.col("_best").isNotNull() & ~gaps & (F.col("n_rows") >= LEAST_ROWS)
    error = F.when(gaps, "series has missing values").when(~fine, F.format_string("too few points: %d", F.size("y")))
    newest = lambda values, k: F.slice(F.reverse(values), F.lit(1), k)
    keep = F.lit(m)
    models = chosen.select(
        "id", "last_date", F.when(fine, "ok").otherwise("error").alias("status"), error.alias("error"),
        F.when(fine, F.concat(F.col("_best.variant"), F.format_string(" d=%d D=%d", "plain", "seasonal"))).alias("variant"),
        "seasonal", "plain", F.when(fine, F.col("_best.aicc")).alias("aicc"), F.when(fine, F.col("_best.sigma2")).alias("sigma2"),
        F.when(fine, F.col("_best.coef")).alias("coef"), "y", "z", _carry(m).alias("carry"),
    )
    shocks = models.withColumn("_e", F.when(F.col("status") == "ok", _shocks(m)))
    return shocks.select(
        "id", "last_date", "status", "error", "variant", "seasonal", "plain", "aicc", "sigma2", "coef", "carry",
        newest(F.col("y"), F.size("carry")).alias("ys"), newest(F.col("z"), keep).alias("zs"), newest(F.col("_e"), keep).alias("es"),
    )


def _ahead(coef: Column, zs: Column, es: Column, m: int) -> Column:
    """The next difference from the newest differences and shocks."""
    known = F.array(
        F.lit(1.0), *[F.coalesce(F.get(zs, F.lit(i)), F.lit(0.0)) for i in (*range(MAX_P), m - 1)],
        *[F.coalesce(F.get(es, F.lit(i)), F.lit(0.0)) for i in (*range(MAX_Q), m - 1)],
    )
    return dot(coef, known)


def _shocks(m: int) -> Column:
    """Each difference minus its one-step forecast, the shocks before the first full row of lags taken as 0."""
    begin = F.when(F.size("z") > 3 * m, F.lit(m)).otherwise(F.lit(MAX_P))

    def folded(coef: Column) -> Column:
        def step(state: Column, v: Column) -> Column:
            t = F.size(state["e"])
            miss = F.when(t < begin, F.lit(0.0)).otherwise(v - _ahead(coef, state["zs"], F.slice(F.reverse(state["e"]), 1, m), m))
            return F.struct(F.slice(F.concat(F.array(v), state["zs"]), 1, m).alias("zs"), F.concat(state["e"], F.array(miss)).alias("e"))

        return F.aggregate("z", F.struct(doubles().alias("zs"), doubles().alias("e")), step)["e"]

    return bind(F.col("coef"), folded)


def arma_forecast(models: DataFrame, horizon: int, freq: Freq = MONTH, season: int | None = None, model_id: str = "arma") -> DataFrame:
    """``id, model_id, variant, step, date, prediction`` of the models that were fitted."""
    m = season or freq.season

    def step(state: Column, _: Column) -> Column:
        def with_z(z: Column) -> Column:
            def with_y(y: Column) -> Column:
                return F.struct(
                    F.slice(F.concat(F.array(y), state["ys"]), 1, F.size("carry")).alias("ys"),
                    F.slice(F.concat(F.array(z), state["zs"]), 1, m).alias("zs"),
                    F.slice(F.concat(F.array(F.lit(0.0)), state["es"]), 1, m).alias("es"),
                    F.concat(state["path"], F.array(y)).alias("path"),
                )

            return bind(z + dot(F.col("carry"), state["ys"]), with_y)

        return bind(_ahead(F.col("coef"), state["zs"], state["es"], m), with_z)

    start = F.struct("ys", "zs", "es", doubles().alias("path"))
    done = models.filter("status = 'ok'").withColumn("path", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step)["path"])
    return done.select("id", "variant", "last_date", F.posexplode("path").alias("_pos", "prediction")).select(
        "id", F.lit(model_id).alias("model_id"), "variant", (F.col("_pos") + 1).cast("bigint").alias("step"),
        freq.add(F.col("last_date"), F.col("_pos") + 1).alias("date"), "prediction",
    )


def advance(models: DataFrame, new_rows: DataFrame, freq: Freq = MONTH, season: int | None = None) -> DataFrame:
    """The models after new observations, coefficients as they were.

    New rows follow the last date of their series; a period without one, or with a null, is
    taken as it was expected. Rows up to the last date, and series without a model, are left out.
    """
    m = season or freq.season
    arrived = new_rows.select("id", "date", "value").join(models.select("id", "last_date"), "id").filter("date > last_date")
    place = freq.between(F.col("last_date"), F.col("date")).cast("int")
    packed = arrived.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("k"), "value"))).alias("_new"))

    def step(state: Column, k: Column) -> Column:
        def with_guess(guess: Column) -> Column:
            def with_y(y: Column) -> Column:
                z = y - dot(F.col("carry"), state["ys"])
                return F.struct(
                    F.slice(F.concat(F.array(y), state["ys"]), 1, F.size("carry")).alias("ys"),
                    F.slice(F.concat(F.array(z), state["zs"]), 1, m).alias("zs"),
                    F.slice(F.concat(F.array(z - guess), state["es"]), 1, m).alias("es"),
                )

            return bind(F.coalesce(F.try_element_at("_new", k), guess + dot(F.col("carry"), state["ys"])), with_y)

        return bind(_ahead(F.col("coef"), state["zs"], state["es"], m), with_guess)

    both = models.join(packed, "id", "left")
    periods = F.coalesce(F.array_max(F.map_keys("_new")), F.lit(0))
    moved = F.aggregate(upto(F.lit(1), periods), F.struct("ys", "zs", "es"), step)
    taken = (F.col("status") == "ok") & (periods > 0)
    new_state = {c: F.when(taken, moved[c]).otherwise(F.col(c)) for c in ("ys", "zs", "es")}
    date = F.when(taken, freq.add(F.col("last_date"), periods)).otherwise(F.col("last_date"))
    return both.select(*[new_state[c].alias(c) if c in new_state else date.alias(c) if c == "last_date" else c for c in models.columns])
