"""Global against series-specific models, model against model, final reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.labels import recode
from panelweave.operators.ranking import union_benchmarks


def winner(left: Column, right: Column, left_name: str, right_name: str) -> Column:
    """Name of the smaller side, ``Tie`` if neither is."""
    return F.when(left < right, left_name).when(right < left, right_name).otherwise("Tie")


def global_vs_local(global_by_id: DataFrame, local_best: DataFrame) -> DataFrame:
    """The chosen global model next to each series' own best one."""
    left = global_by_id.select("id", *[F.col(m).alias(f"global_{m}") for m in ("rmse", "mae", "mape")])
    right = local_best.select(
        "id",
        F.col("model_id").alias("local_model"),
        *[F.col(m).alias(f"local_{m}") for m in ("rmse", "mae", "mape")],
    )
    gap = F.col("global_rmse") - F.col("local_rmse")
    return left.join(right, "id").select(
        "*",
        winner(F.col("global_rmse"), F.col("local_rmse"), "Global", "Series-Specific").alias("winner"),
        gap.alias("rmse_improvement"),
        F.try_divide(gap * 100, F.col("global_rmse")).alias("rmse_improvement_pct"),
    )


def gap_long(comparison: DataFrame) -> DataFrame:
    """Two rows per series (global, local) with the absolute gap: chart data."""
    names = {"global_rmse": "Global", "local_rmse": "Series-Specific"}
    wide = comparison.select(
        "id", "global_rmse", "local_rmse", F.abs(F.col("global_rmse") - F.col("local_rmse")).alias("rmse_gap")
    )
    long = wide.unpivot(["id", "rmse_gap"], list(names), "strategy", "rmse")
    return long.withColumn("strategy", recode(F.col("strategy"), names))


def two_model_winner(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """By-series accuracy of two models side by side with the better one named."""
    a = left.select("id", *[F.col(m).alias(f"{left_name}_{m}") for m in ("rmse", "mae", "mape")])
    b = right.select("id", *[F.col(m).alias(f"{right_name}_{m}") for m in ("rmse", "mae", "mape")])
    return a.join(b, "id").withColumn(
        "winner", winner(F.col(f"{left_name}_rmse"), F.col(f"{right_name}_rmse"), left_name, right_name)
    )


def hybrid_policy(global_by_id: DataFrame, local_best: DataFrame) -> DataFrame:
    """Global by default, the local model where it is strictly better."""
    both = global_by_id.select("id", F.col("model_id").alias("global_model"), F.col("rmse").alias("global_rmse")).join(
        local_best.select("id", F.col("model_id").alias("local_model"), F.col("rmse").alias("local_rmse")), "id"
    )
    local = F.col("local_rmse") < F.col("global_rmse")
    return both.select(
        "id",
        F.when(local, F.col("local_model")).otherwise(F.col("global_model")).alias("model_id"),
        F.when(local, "Series-Specific").otherwise("Global").alias("source"),
        F.least("global_rmse", "local_rmse").alias("rmse"),
    )


def policy_rows(policy: DataFrame, calibrated: DataFrame, name: str = "hybrid_policy") -> DataFrame:
    """The calibrated rows a policy picks, as one model to be scored like any other."""
    picked = calibrated.join(policy.select("id", "model_id"), ["id", "model_id"], "left_semi")
    return picked.withColumn("model_id", F.lit(name))


def final_benchmark(tables: list[DataFrame]) -> DataFrame:
    """All models on the same four columns."""
    cols = ["model_id", "rmse", "mae", "mape"]
    return union_benchmarks([t.select(cols) for t in tables])


def run_summary(benchmark: DataFrame, comparison: DataFrame, top: int = 10) -> DataFrame:
    """Best models and winner counts as one long table ``(section, item, value)``."""
    leaders = benchmark.orderBy(F.col("rmse").asc_nulls_last(), "model_id").limit(top).select(
        F.lit("top_models").alias("section"), F.col("model_id").alias("item"), F.col("rmse").alias("value")
    )
    wins = comparison.groupBy("winner").agg(F.count("*").cast("double").alias("value")).select(
        F.lit("global_vs_local").alias("section"), F.col("winner").alias("item"), "value"
    )
    return leaders.unionByName(wins)
