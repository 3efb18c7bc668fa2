"""Combining member forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.labels import UNSTACKABLE_PATTERN, matches
from panelweave.operators.ranking import keep_models, top_k_ties

MEMBERS = 4
STACK_MEMBERS = 3


def ensemble_candidates(accuracy: DataFrame, k: int = MEMBERS, metric: str = "rmse") -> DataFrame:
    """The k best models."""
    return top_k_ties(accuracy, metric, k)


def member_forecasts(forecasts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Forecasts of the chosen members."""
    return keep_models(forecasts, candidates)


def ensemble_weights(candidates: DataFrame, metric: str = "rmse") -> DataFrame:
    """Weight k for the best of k members down to 1 for the worst, scaled to sum 1.

    The window runs over the chosen members only, a handful of rows.
    """
    everyone = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(metric, "model_id"))
    raw = candidates.select("model_id", place.alias("_place"), F.count("*").over(everyone).alias("_k"))
    points = F.col("_k") - F.col("_place") + 1
    return raw.select("model_id", (points / F.sum(points).over(everyone)).alias("weight"))


def combine(members: DataFrame, candidates: DataFrame, how: str, allow_partial: bool = False) -> DataFrame:
    """``mean``, ``median`` or ``weighted`` forecast per id and date.

    A date some member does not cover gets a null forecast, unless partial
    rows are allowed; ``n_members`` tells how many took part. ``candidates``
    holds one row per member, so its count and weights are small by nature.
    """
    if how == "weighted":
        members = members.join(F.broadcast(ensemble_weights(candidates)), "model_id")
        value = F.sum(F.col("weight") * F.col("prediction")) / F.sum(F.when(F.col("prediction").isNotNull(), F.col("weight")))
    else:
        value = {"mean": F.avg("prediction"), "median": F.median("prediction")}[how]
    grouped = members.groupBy("id", "date").agg(value.alias("_value"), F.count("prediction").alias("n_members"))
    expected = candidates.agg(F.count("*")).scalar()
    complete = F.lit(allow_partial) | (F.col("n_members") == expected)
    return grouped.select(
        "id",
        "date",
        F.lit(f"ensemble_{how}").alias("model_id"),
        F.when(complete, F.col("_value")).alias("prediction"),
        "n_members",
    )


def stack_base(accuracy: DataFrame, desc: str = "model_desc", k: int = STACK_MEMBERS, metric: str = "rmse") -> DataFrame:
    """The k best models that can be refitted on rolling slices."""
    return top_k_ties(accuracy.filter(~matches(F.col(desc), UNSTACKABLE_PATTERN)), metric, k)
