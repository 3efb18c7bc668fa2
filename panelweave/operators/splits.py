"""Holdouts, rolling-origin plans, tails and nested series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators.panel import by_time


def distinct_dates(panel: DataFrame, newest_first: bool = False) -> DataFrame:
    """One row holding the sorted distinct dates of the whole panel, as ``dates``.

    Dates are folded on the map side; the array is as long as the calendar.
    """
    return panel.agg(F.sort_array(F.collect_set("date"), asc=not newest_first).alias("dates"))


def holdout_start(panel: DataFrame, assess: int) -> Column:
    """First of the last ``assess`` distinct dates of the panel, as a scalar subquery."""
    row = distinct_dates(panel, newest_first=True).select(
        F.coalesce(
            F.get("dates", F.lit(assess - 1)),
            F.raise_error(F.lit(f"panel has fewer than {assess} distinct dates")).cast("date"),
        )
    )
    return row.scalar()


def time_split(panel: DataFrame, assess: int) -> DataFrame:
    """Add ``role``: ``test`` on the last ``assess`` distinct dates, ``train`` before."""
    return panel.withColumn("role", F.when(F.col("date") < holdout_start(panel, assess), "train").otherwise("test"))


def train_rows(panel: DataFrame, assess: int) -> DataFrame:
    """Rows before the holdout."""
    return panel.filter(F.col("date") < holdout_start(panel, assess))


def test_rows(panel: DataFrame, assess: int) -> DataFrame:
    """Rows of the holdout; the one truth table every model is scored on."""
    return panel.filter(F.col("date") >= holdout_start(panel, assess))


def cv_plan(
    panel: DataFrame, initial: int, assess: int, skip: int, slice_limit: int, cumulative: bool = True
) -> DataFrame:
    """Rolling origins stepping back from the newest, one row per slice.

    Slice j trains on the first ``n - assess - j * skip`` dates (all of them, or
    the last ``initial`` of them) and tests on the next ``assess``; slices with
    fewer than ``initial`` training dates are left out.
    """
    n_train = F.col("n") - assess - F.col("j") * skip
    dates = F.col("dates")
    start = F.lit(0) if cumulative else F.col("n_train") - initial
    return (
        distinct_dates(panel)
        .withColumn("n", F.size("dates"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(slice_limit - 1))))
        .withColumn("n_train", n_train)
        .filter(F.col("n_train") >= initial)
        .select(
            (F.col("j") + 1).cast("bigint").alias("slice_id"),
            F.get(dates, start).alias("train_start"),
            F.get(dates, F.col("n_train") - 1).alias("train_end"),
            F.get(dates, F.col("n_train")).alias("test_start"),
            F.get(dates, F.col("n_train") + assess - 1).alias("test_end"),
        )
    )


def plan_dates(panel: DataFrame, plan: DataFrame) -> DataFrame:
    """``(slice_id, role, date)``: the plan spelled out by date, at most slices times calendar rows."""
    d = F.col("date")
    role = F.when(d <= F.col("train_end"), "training").otherwise("testing")
    span = F.array_compact(
        F.transform(
            F.col("dates"),
            lambda x: F.when((x >= F.col("train_start")) & (x <= F.col("test_end")), x),
        )
    )
    return (
        plan.withColumn("dates", distinct_dates(panel).scalar())
        .withColumn("date", F.explode(span))
        .select("slice_id", role.alias("role"), "date")
    )


def cv_rows(panel: DataFrame, plan: DataFrame) -> DataFrame:
    """Panel rows of every slice with their role: an equi-join on ``date``.

    A shuffle on ``date`` would leave one task per period, each with every
    series. The date side holds at most slices times calendar periods whatever
    the data size, so it is broadcast.
    """
    return panel.join(F.broadcast(plan_dates(panel, plan)), "date")


def panel_tail(panel: DataFrame, n: int, keys: Sequence[str] = ("id",)) -> DataFrame:
    """The last ``n`` rows of each id."""
    return (
        panel.withColumn("_rn", F.row_number().over(by_time(keys, newest_first=True)))
        .filter(F.col("_rn") <= n)
        .drop("_rn")
    )


def nest_series(panel: DataFrame, length_future: int) -> DataFrame:
    """One row per id: date-ordered ``actual_data`` and the last ``length_future`` points as ``future_data``.

    Run it on an extended panel, so that the future part holds the empty periods.
    """
    points = F.sort_array(F.collect_list(F.struct("date", "value")))
    n_actual = F.greatest(F.size("points") - length_future, F.lit(0))
    return (
        panel.groupBy("id")
        .agg(points.alias("points"))
        .select(
            "id",
            F.slice("points", F.lit(1), n_actual).alias("actual_data"),
            F.slice("points", n_actual + 1, F.lit(length_future)).alias("future_data"),
        )
    )


def split_nested(nested: DataFrame, length_test: int) -> DataFrame:
    """Flat ``(id, role, date, value)``: the last ``length_test`` actual points of each id are ``test``."""
    return nested.select(
        "id",
        (F.size("actual_data") - length_test).alias("_n_train"),
        F.posexplode("actual_data").alias("_pos", "point"),
    ).select(
        "id",
        F.when(F.col("_pos") < F.col("_n_train"), "train").otherwise("test").alias("role"),
        F.col("point.date").alias("date"),
        F.col("point.value").alias("value"),
    )


def context_and_truth(panel: DataFrame, assess: int) -> tuple[DataFrame, DataFrame]:
    """What an outside model may see, and what it will be scored on."""
    cols = ["id", "date", "value"]
    return train_rows(panel, assess).select(cols), test_rows(panel, assess).select(cols)
