"""Leaderboards: top-k with and without ties, best per series, unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINAL_TIE_BREAK = "model_id"


def top_k_ties(df: DataFrame, metric: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k smallest per group, rows tied with the last one kept.

    Without a group only the k-th smallest value is looked up (a bounded
    top-k), then the table is filtered by it: no single-task ranking.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(metric)
        return df.withColumn("_rank", F.rank().over(w)).filter(F.col("_rank") <= k).drop("_rank")
    present = df.filter(F.col(metric).isNotNull())
    worst_kept = present.select(metric).orderBy(metric).limit(k).agg(F.max(metric)).scalar()
    return present.filter(F.col(metric) <= worst_kept)


def top_1(df: DataFrame, metric: str, by: Sequence[str] = (), tie_break: str = FINAL_TIE_BREAK) -> DataFrame:
    """One row per group, always the same one."""
    if by:
        w = Window.partitionBy(*by).orderBy(metric, tie_break)
        return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return head_n(df, metric, 1, tie_break)


def head_n(df: DataFrame, metric: str, n: int, tie_break: str = FINAL_TIE_BREAK) -> DataFrame:
    """The first n rows in order of ``metric``."""
    return df.orderBy(F.col(metric).asc_nulls_last(), F.col(tie_break)).limit(n)


def count_sorted(df: DataFrame, *by: str) -> DataFrame:
    """Rows per key, most frequent first."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def best_per_series(accuracy: DataFrame, metric: str = "rmse", minimize: bool = True) -> DataFrame:
    """The best model of each series."""
    order = F.col(metric).asc_nulls_last() if minimize else F.col(metric).desc_nulls_last()
    w = Window.partitionBy("id").orderBy(order, FINAL_TIE_BREAK)
    return accuracy.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_models(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows whose model is among the chosen ones.

    ``chosen`` has one row per model: bounded by the model list, not the data,
    hence broadcast; a shuffle on the few model ids would be all skew.
    """
    return rows.join(F.broadcast(chosen.select("model_id").distinct()), "model_id", "left_semi")


def union_benchmarks(tables: Sequence[DataFrame]) -> DataFrame:
    """Accuracy tables one below the other, matched by name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def display_rank(df: DataFrame, metric: str, tie_break: str, name: str = "display_rank") -> DataFrame:
    """1 for the row drawn first. For leaderboards already cut to a fixed n."""
    w = Window.orderBy(F.col(metric).asc_nulls_last(), F.col(tie_break))
    return df.withColumn(name, F.row_number().over(w).cast("bigint"))


def order_by_least(df: DataFrame, *cols: str) -> DataFrame:
    """Order rows by the smaller of several columns."""
    return df.orderBy(F.least(*[F.col(c) for c in cols]))


def first_present(df: DataFrame, names: Sequence[str]) -> str:
    """The first of ``names`` that is a column of ``df``."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(names)} among the columns {df.columns}")


def model_table(spark, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Model dimension ``(model_id, model_desc, family)``; the id is given once and never positional."""
    return spark.createDataFrame(list(rows), "model_id string, model_desc string, family string")


def relabel(models: DataFrame, column: str, new_names: dict[str, str]) -> DataFrame:
    """Change descriptions of the listed model ids."""
    updates: Column = F.col(column)
    for model_id, text in new_names.items():
        updates = F.when(F.col("model_id") == model_id, F.lit(text)).otherwise(updates)
    return models.withColumn(column, updates)
