"""Lag, rolling, calendar and indicator features over a panel."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.panel import by_time
from panelweave.session import materialize

HORIZON = 24
ROLL_SOURCE_LAG = 12
ROLL_PERIOD = 12


def add_lags(panel: DataFrame, lags: Iterable[int] = range(1, HORIZON + 1), keys: Sequence[str] = ("id",)) -> DataFrame:
    """``value_lag<k>`` for every k, within the id; future rows see history."""
    w = by_time(keys)
    return panel.withColumns({f"value_lag{k}": F.lag("value", k).over(w) for k in lags})


def add_rolling_mean(
    df: DataFrame,
    source: str = f"value_lag{ROLL_SOURCE_LAG}",
    before: int = ROLL_PERIOD - 1,
    after: int = 0,
    keys: Sequence[str] = ("id",),
) -> DataFrame:
    """Partial moving mean of ``source``; the default looks back only.

    A centred frame (``before=6, after=5``) reads rows that a recursive forecast
    has not produced yet, so models are trained on the trailing one.
    """
    name = f"{source}_roll_{before + after + 1}"
    return df.withColumn(name, F.avg(source).over(by_time(keys).rowsBetween(-before, after)))


def lag_features(panel: DataFrame, lags: Iterable[int] = range(1, HORIZON + 1), keys: Sequence[str] = ("id",)) -> DataFrame:
    """Lags and the rolling mean in one pass over one window spec."""
    return add_rolling_mean(add_lags(panel, lags, keys), keys=keys)


def prepared_rows(df: DataFrame) -> DataFrame:
    """Known values whose features are all present."""
    return df.filter(F.col("value").isNotNull()).na.drop("any")


def future_rows(df: DataFrame) -> DataFrame:
    """Rows still to be forecast."""
    return df.filter(F.col("value").isNull())


def columns_like(df: DataFrame, starts_with: Sequence[str] = (), contains: Sequence[str] = ()) -> list[str]:
    """Column names that start with, or hold, any of the given texts."""
    return [
        c
        for c in df.columns
        if any(c.startswith(s) for s in starts_with) or any(s in c for s in contains)
    ]


def drop_like(df: DataFrame, starts_with: Sequence[str] = (), contains: Sequence[str] = ()) -> DataFrame:
    """``df`` without the columns named by :func:`columns_like`."""
    return df.drop(*columns_like(df, starts_with, contains))


def category_levels(df: DataFrame, column: str, limit: int = 1000) -> list[str]:
    """The values of a nominal column, in order; refuses columns with too many."""
    found = [r[0] for r in df.select(column).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels; describe them by numbers, as series_levels does")
    return sorted(v for v in found if v is not None)


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column per level seen in training; an unseen value is all zero."""
    flags = {
        f"{column}_{level}": F.coalesce((F.col(column) == level).cast("bigint"), F.lit(0).cast("bigint"))
        for level in levels
    }
    return df.withColumns(flags)


def level_index(df: DataFrame, column: str) -> DataFrame:
    """``(column, level)``: every value with its place in order, from 0, however many there are.

    Values are sorted in ranges; a range numbers its own and is told how many lie before it. Null is no level.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    lined = values.repartitionByRange(column).sortWithinPartitions(column)
    lined = materialize(lined.select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_line")), "levels")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = lined.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_line").alias("_first"))
    parts = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    return lined.join(F.broadcast(parts), "_part").select(column, (F.col("_ahead") + F.col("_line") - F.col("_first")).alias("level"))


def one_hot_sparse(df: DataFrame, column: str, levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The non-zero cells of the 0/1 columns, ``(keys, level, cell)``; ``levels`` is the :func:`level_index` of training.

    An unseen value and null have no cell. The levels have one row per value; the planner sends them along where
    they are small and splits a value that many rows share where they are not.
    """
    return df.select(*keys, column).join(levels, column).select(*keys, "level", F.lit(1).cast("bigint").alias("cell"))


def normalize(df: DataFrame, columns: Sequence[str], train: DataFrame) -> DataFrame:
    """Centre and scale with the mean and sample deviation of ``train``; a constant column becomes null.

    The statistics are one row, read by the plan as a scalar subquery.
    """
    stats = train.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_samp(c).alias(f"{c}_sd") for c in columns]
        ).alias("stats")
    ).scalar()
    scaled = {c: F.try_divide(F.col(c) - stats[f"{c}_mean"], stats[f"{c}_sd"]) for c in columns}
    return df.withColumns(scaled)


def variance_report(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, is_constant)`` for each column, from one aggregation pass."""
    lo_hi = train.agg(
        *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(columns)],
    )
    flags: list[Column] = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.col(f"lo_{i}") == F.col(f"hi_{i}"), F.lit(True)).alias("is_constant"),
        )
        for i, c in enumerate(columns)
    ]
    return lo_hi.select(F.inline(F.array(*flags)))


def varying_columns(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns worth keeping as predictors, in the given order."""
    constant = {r["column"] for r in variance_report(train, columns).collect() if r["is_constant"]}
    return [c for c in columns if c not in constant]
