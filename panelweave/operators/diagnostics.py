"""Numbers behind the diagnostic views of a panel, and cleaning based on them.

Where whole-series statistics are needed next to the rows (means, quartiles,
seasonal means) they are windows over ``id`` or a refinement of it, so the
single exchange on ``id`` made for the first window serves all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.steps import MONTH, Freq
from panelweave.operators.panel import by_time, impute_linear

DAY_SECONDS = 86400.0
IQR_PER_ALPHA = 0.15
MAX_ANOMALY_SHARE = 0.2
ACF_LAGS = 60


def ts_summary(df: DataFrame, date: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, first and last day, and the distribution of steps between rows in seconds.

    Rows are folded to counts per day before they are put in order: n rows on
    one day are n - 1 steps of zero, so the ordered table is calendar-sized.
    """
    by = list(by)
    days = df.groupBy(*by, F.to_date(date).alias("date")).agg(F.count("*").alias("_n"))
    gap = F.date_diff("date", F.lag("date").over(by_time(by))) * F.lit(DAY_SECONDS)
    steps = days.withColumn("_gap", gap).select(
        *by, "date", "_n",
        F.inline(F.array(
            F.struct(F.lit(0.0).alias("step"), (F.col("_n") - 1).alias("times"), F.lit(True).alias("first_part")),
            F.struct(F.col("_gap").alias("step"), F.when(F.col("_gap").isNull(), 0).otherwise(1).cast("bigint").alias("times"),
                     F.lit(False).alias("first_part")),
        )),
    )
    present = F.when(F.col("times") > 0, F.col("step"))

    def quantile(p: float) -> Column:
        return F.percentile(present, F.lit(p), F.col("times"))

    return steps.groupBy(*by).agg(
        F.sum(F.when(F.col("first_part"), F.col("_n"))).alias("n_obs"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.min(present).alias("diff_minimum"),
        quantile(0.25).alias("diff_q1"),
        quantile(0.5).alias("diff_median"),
        (F.sum(present * F.col("times")) / F.sum("times")).alias("diff_mean"),
        quantile(0.75).alias("diff_q3"),
        F.max(present).alias("diff_maximum"),
    )


def trend_smooth(panel: DataFrame, half_width: int = 6, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Centred moving average, partial at both ends."""
    frame = by_time(keys).rowsBetween(-half_width, half_width)
    return panel.withColumn("smooth", F.avg("value").over(frame))


def seasonal_boxplot(panel: DataFrame) -> DataFrame:
    """Five-number summary of each series by month, quarter and year."""
    day = F.col("date")
    long = panel.select(
        "id",
        "value",
        F.inline(
            F.array(
                F.struct(F.lit("month").alias("feature"), F.month(day).cast("bigint").alias("bucket")),
                F.struct(F.lit("quarter").alias("feature"), F.quarter(day).cast("bigint").alias("bucket")),
                F.struct(F.lit("year").alias("feature"), F.year(day).cast("bigint").alias("bucket")),
            )
        ),
    )
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    boxes = long.groupBy("id", "feature", "bucket").agg(
        F.min("value").alias("lower"), q.alias("_q"), F.max("value").alias("upper"), F.count("value").alias("n")
    )
    return boxes.select(
        "id", "feature", "bucket", "lower",
        F.get("_q", F.lit(0)).alias("q1"), F.get("_q", F.lit(1)).alias("median"), F.get("_q", F.lit(2)).alias("q3"),
        "upper", "n",
    )


def acf_arrays(panel: DataFrame, lags: int = ACF_LAGS) -> DataFrame:
    """``(id, n, acf)`` with the autocorrelations of lags 0..min(lags, n-1).

    Products with the k-th row back are lag windows over one sort, so no pairs
    are joined and memory does not grow with the series.
    """
    centred = panel.withColumn("_x", F.col("value") - F.avg("value").over(Window.partitionBy("id")))
    w = by_time()
    products = centred.withColumns(
        {f"_p{k}": F.col("_x") * (F.col("_x") if k == 0 else F.lag("_x", k).over(w)) for k in range(lags + 1)}
    )
    sums = products.groupBy("id").agg(
        F.count("_x").alias("n"), *[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(lags + 1)]
    )
    values = F.array(*[F.try_divide(f"_p{k}", "_p0") for k in range(lags + 1)])
    return sums.select("id", "n", F.slice(values, F.lit(1), F.least(F.col("n").cast("int"), F.lit(lags + 1))).alias("acf"))


def acf(panel: DataFrame, lags: int = ACF_LAGS) -> DataFrame:
    """One row per id and lag with the white-noise band."""
    return acf_arrays(panel, lags).select(
        "id", F.posexplode("acf").alias("lag", "acf"), (F.lit(2.0) / F.sqrt("n")).alias("band")
    ).withColumn("lag", F.col("lag").cast("bigint"))


def pacf(panel: DataFrame, lags: int = ACF_LAGS) -> DataFrame:
    """Partial autocorrelations by the Durbin–Levinson recursion over each id's ACF array."""
    r = F.col("acf")

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def advance(state: Column, k: Column) -> Column:
        known = F.slice(r, F.lit(2), k - 1)
        top = F.get(r, k) - dot(state["phi"], F.reverse(known))
        newest = F.try_divide(top, F.lit(1.0) - dot(state["phi"], known))

        def with_newest(v: Column) -> Column:
            older = F.zip_with(state["phi"], F.reverse(state["phi"]), lambda a, b: a - v * b)
            return F.struct(
                F.concat(older, F.array(v)).alias("phi"), F.concat(state["out"], F.array(v)).alias("out")
            )

        return F.get(F.transform(F.array(newest), with_newest), F.lit(0))

    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), empty.alias("out"))
    steps = F.when(F.size(r) > 1, F.sequence(F.lit(1), F.size(r) - 1)).otherwise(F.array().cast("array<int>"))
    return (
        acf_arrays(panel, lags)
        .withColumn("_pacf", F.aggregate(steps, start, advance)["out"])
        .select("id", F.posexplode("_pacf").alias("_pos", "pacf"))
        .select("id", (F.col("_pos") + 1).cast("bigint").alias("lag"), "pacf")
    )


def season_index(freq: Freq, season: int) -> Column:
    """Position of a date in the seasonal cycle, the same for every series."""
    return F.pmod(freq.between(F.lit("1970-01-01").cast("date"), F.col("date")), F.lit(season))


def _season_trend(m: int) -> Column:
    """Centred average over one whole season (two averages if it is even), null at the ends."""
    half, w = m // 2, by_time()
    frames = [w.rowsBetween(-half, half)] if m % 2 else [w.rowsBetween(-half, half - 1), w.rowsBetween(1 - half, half)]
    averages = [F.when(F.count("value").over(f) == m, F.avg("value").over(f)) for f in frames]
    return averages[0] if m % 2 else (averages[0] + averages[1]) / 2


def decompose(panel: DataFrame, freq: Freq = MONTH, season: int | None = None) -> DataFrame:
    """Trend, season, remainder and seasonally adjusted value of every row.

    Trend is the centred average over one season (two averages for an even
    season), empty at the ends; seasonal means are centred to sum to zero.
    """
    m = season or freq.season
    cell = Window.partitionBy("id", "_season_index")
    first_of_cell = F.row_number().over(cell.orderBy("date")) == 1
    return (
        panel.select("id", "date", "value")
        .withColumn("trend", _season_trend(m))
        .withColumn("_season_index", season_index(freq, m))
        .withColumn("_cell_mean", F.avg(F.col("value") - F.col("trend")).over(cell))
        .withColumn("_cell_head", F.when(first_of_cell, F.col("_cell_mean")))
        .withColumn("season", F.col("_cell_mean") - F.avg("_cell_head").over(Window.partitionBy("id")))
        .withColumn("remainder", F.col("value") - F.col("trend") - F.col("season"))
        .withColumn("seasadj", F.col("value") - F.col("season"))
        .drop("_season_index", "_cell_mean", "_cell_head")
    )


def _fence(column: str, alpha: float) -> tuple[Column, Column]:
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).over(Window.partitionBy("id"))
    low, high = F.get(q, F.lit(0)), F.get(q, F.lit(1))
    reach = (high - low) * (IQR_PER_ALPHA / alpha)
    return low - reach, high + reach


def anomalies(
    panel: DataFrame,
    freq: Freq = MONTH,
    season: int | None = None,
    alpha: float = 0.05,
    max_share: float = MAX_ANOMALY_SHARE,
) -> DataFrame:
    """Rows whose remainder leaves the quartile fence; at most ``max_share`` of a series, widest first."""
    lo, hi = _fence("remainder", alpha)
    outside = F.greatest(F.col("lo") - F.col("remainder"), F.col("remainder") - F.col("hi"))
    widest = Window.partitionBy("id").orderBy(F.col("_outside").desc_nulls_last(), "date")
    n = F.count("remainder").over(Window.partitionBy("id"))
    return (
        decompose(panel, freq, season)
        .withColumn("lo", lo)
        .withColumn("hi", hi)
        .withColumn("_outside", outside)
        .withColumn("_allowed", F.row_number().over(widest) <= n * max_share)
        .withColumn("is_anomaly", F.coalesce((F.col("_outside") > 0) & F.col("_allowed"), F.lit(False)))
        .select("id", "date", "value", "trend", "season", "remainder", "lo", "hi", "is_anomaly")
    )


def outlier_clean(train: DataFrame, freq: Freq = MONTH, season: int | None = None, alpha: float = 0.05) -> DataFrame:
    """Replace outliers of the training rows by interpolation; ``value_raw`` keeps the original.

    The season is the median deviation from the seasonal average. What is left
    is taken off the series' straight line (no bias at the ends of a trend) and
    compared with the median of the rows around it, so that a spike bends
    neither its season nor its neighbours. Rows outside the quartile fence of
    those differences are replaced. Learned on, and applied to, training rows.
    """
    m = season or freq.season
    lo, hi = _fence("_rest", alpha)
    cell = Window.partitionBy("id", "_season_index")
    around = by_time().rowsBetween(-(m // 2), m // 2)
    whole = Window.partitionBy("id")
    line = F.regr_intercept("_adjusted", "_pos").over(whole) + F.regr_slope("_adjusted", "_pos").over(whole) * F.col("_pos")
    flagged = (
        train.select("id", "date", F.col("value").alias("value_raw"), "value")
        .withColumn("_off_trend", F.col("value") - _season_trend(m))
        .withColumn("_pos", F.row_number().over(by_time()).cast("double"))
        .withColumn("_season_index", season_index(freq, m))
        .withColumn("_adjusted", F.col("value") - F.coalesce(F.median("_off_trend").over(cell), F.lit(0.0)))
        .withColumn("_off_line", F.col("_adjusted") - F.coalesce(line, F.col("_adjusted")))
        .withColumn("_rest", F.col("_off_line") - F.percentile("_off_line", F.lit(0.5)).over(around))
        .withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .withColumn("is_cleaned", F.coalesce(~F.col("_rest").between(F.col("_lo"), F.col("_hi")), F.lit(False)))
        .withColumn("value", F.when(~F.col("is_cleaned"), F.col("value")))
    )
    return impute_linear(flagged).select("id", "date", "value", "value_raw", "is_cleaned")
