"""From dated observations to a regular panel.

All per-series windows here use the one spec ``partition by id order by date``
(and its mirror), so pad, impute and extend share a single exchange on ``id``.
They expect bucketed input, one row per id and period; :func:`bucket_sum` folds
raw rows on the map side first, which is also what takes the heat out of an id
that holds a large share of the raw data.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.steps import MONTH, Freq

MONEY_SCALE = 2  # for columns known to hold cents; never a default


def by_time(keys: Sequence[str] = ("id",), newest_first: bool = False):
    """The window every per-series operator shares."""
    order = F.col("date").desc() if newest_first else F.col("date").asc()
    return Window.partitionBy(*keys).orderBy(order)


def filter_by_time(df: DataFrame, column: str, start: str | Date | None = None, end: str | Date | None = None) -> DataFrame:
    """Rows between two days, both included; a missing side is open."""
    day = F.col(column)
    if start is not None:
        df = df.filter(day >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(day < F.date_add(F.lit(end).cast("date"), 1))
    return df


def exact_sum(value: Column, scale: int | None = None) -> Column:
    """Sum of doubles as they are; with ``scale``, one that does not depend on row order.

    A scale is the caller's statement that values have no more decimals: they are then
    added as whole units of the last place. Going through a whole number is about twice
    as fast as casting each double to a decimal with places. A NaN makes the sum NaN and
    an infinity makes it infinite, with or without a scale; nulls are left out.
    """
    if scale is None:
        return F.sum(value)
    unit = 10**scale
    double = value.cast("double")
    odd = F.isnan(double) | (F.abs(double) == float("inf"))
    whole = F.when(~odd, F.rint(double * unit)).cast("bigint").cast("decimal(18,0)")
    return F.when(F.bool_or(odd), F.sum(double)).otherwise(F.sum(whole).cast("double") / unit)


def bucket_sum(
    df: DataFrame,
    by: Sequence[Column],
    date: str,
    value: str,
    freq: Freq = MONTH,
    scale: int | None = None,
) -> DataFrame:
    """Sum of ``value`` per key and period, as ``(keys…, date, value)``."""
    period = freq.floor(F.col(date)).alias("date")
    return df.groupBy(*by, period).agg(exact_sum(F.col(value), scale).alias("value"))


def bucket_sum_by_attribute(
    facts: DataFrame,
    dimension: DataFrame,
    key: tuple[str, str],
    attribute: str,
    date: str,
    value: str,
    freq: Freq = MONTH,
    scale: int | None = None,
) -> DataFrame:
    """Sum per attribute of a dimension and period, as ``(id, date, value)``; ``key`` pairs the join columns.

    The facts are summed per key and period first, on the map side, so a key with a
    large share of the rows joins as one row per period; how to join is the planner's choice.
    """
    fact_key, dim_key = key
    names = dimension.select(F.col(dim_key).alias("_key"), F.col(attribute).alias("id"))
    per_key = bucket_sum(facts, [F.col(fact_key).alias("_key")], date, value, freq, scale)
    return per_key.join(names, "_key").groupBy("id", "date").agg(exact_sum(F.col("value"), scale).alias("value"))


def hierarchy_levels(leaf: DataFrame, upper: Sequence[str], id_col: str = "id", scale: int | None = None) -> DataFrame:
    """Total, upper levels and series of an already bucketed leaf panel.

    The leaf is aggregated before it gets here, so the grouping sets expand
    periods, not raw rows. ``level`` is 0 for the total.
    """
    chain = [*upper, id_col]
    sets = [["date", *chain[:k]] for k in range(len(chain), -1, -1)]
    present = [F.grouping(c) for c in chain]
    level = F.lit(len(chain))
    for flag in present:
        level = level - flag.cast("int")
    grouped = leaf.groupingSets(
        [[F.col(c) for c in s] for s in sets], F.col("date"), *[F.col(c) for c in chain]
    )
    return grouped.agg(
        exact_sum(F.col("value"), scale).alias("value"), level.cast("bigint").alias("level")
    )


def pad(panel: DataFrame, freq: Freq = MONTH, fill: float | None = None, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Fill missing periods between each id's own first and last one.

    Each row carries the empty periods up to its successor, so no calendar is
    joined and the rows stay partitioned by id.
    """
    following = F.lead("date").over(by_time(keys))
    reach = F.greatest(F.coalesce(freq.add(following, -1), F.col("date")), F.col("date"))
    others = [c for c in panel.columns if c not in (*keys, "date", "value", "is_padded")]
    slot = F.col("_slot")
    fresh = slot != F.col("date")
    return (
        panel.withColumn("_reach", reach)
        .withColumn("_slot", F.explode(freq.sequence(F.col("date"), F.col("_reach"))))
        .select(
            *keys,
            slot.alias("date"),
            F.when(fresh, F.lit(fill).cast("double")).otherwise(F.col("value")).alias("value"),
            fresh.alias("is_padded"),
            *[F.when(~fresh, F.col(c)).alias(c) for c in others],
        )
    )


def zero_to_null(panel: DataFrame) -> DataFrame:
    """Treat a zero value as missing."""
    return panel.withColumn("value", F.nullif(F.col("value"), F.lit(0.0)))


def impute_linear(panel: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Straight line between the known neighbours, ends carried, all-null kept null.

    Distance is counted in rows of the padded panel, not in days.
    """
    running = (Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("value").isNotNull(), F.struct("_pos", "value"))
    left, right = F.col("_left"), F.col("_right")
    share = (F.col("_pos") - left["_pos"]) / (right["_pos"] - left["_pos"])
    line = left["value"] + (right["value"] - left["value"]) * share
    filled = (
        F.when(F.col("value").isNotNull(), F.col("value"))
        .when(left.isNull(), right["value"])
        .when(right.isNull(), left["value"])
        .otherwise(line)
    )
    return (
        panel.withColumn("_pos", F.row_number().over(by_time(keys)))
        .withColumn("_left", F.last(known, ignorenulls=True).over(by_time(keys).rowsBetween(*running)))
        .withColumn("_right", F.last(known, ignorenulls=True).over(by_time(keys, True).rowsBetween(*running)))
        .withColumn("_filled", filled)
        .withColumn("is_imputed", F.col("value").isNull() & F.col("_filled").isNotNull())
        .withColumn("value", F.col("_filled"))
        .drop("_pos", "_left", "_right", "_filled")
    )


def regular_panel(
    panel: DataFrame, freq: Freq = MONTH, zero_is_missing: bool = False, keys: Sequence[str] = ("id",)
) -> DataFrame:
    """Bucketed rows to a gap-free panel: pad, optionally blank zeros, interpolate."""
    padded = pad(panel, freq, keys=keys)
    if zero_is_missing:
        padded = zero_to_null(padded)
    return impute_linear(padded, keys)


def extend(panel: DataFrame, horizon: int, freq: Freq = MONTH, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Append ``horizon`` empty periods after each id's last row; history rows kept."""
    last = F.lead("date").over(by_time(keys)).isNull()
    ahead = freq.sequence(F.col("date"), freq.add(F.col("date"), horizon))
    others = [c for c in panel.columns if c not in (*keys, "date")]
    slot = F.col("_slot")
    future = slot != F.col("date")
    return (
        panel.withColumn("_slots", F.when(last, ahead).otherwise(F.array("date")))
        .withColumn("_slot", F.explode("_slots"))
        .select(
            *keys,
            slot.alias("date"),
            *[F.when(~future, F.col(c)).alias(c) for c in others],
            future.alias("is_future"),
        )
    )


def duplicate_periods(df: DataFrame, by: Sequence[Column], date: str, value: str, freq: Freq = MONTH) -> DataFrame:
    """Ids with more than one raw row in a period, and how many of those rows are zero.

    A sum over such periods may be adding rows that belong elsewhere.
    """
    per_period = df.groupBy(*by, freq.floor(F.col(date)).alias("date")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(value) == 0).alias("n_zero")
    )
    return per_period.filter("n_rows > 1")
