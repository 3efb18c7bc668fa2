"""Writers for result tables and models.

Each writer names its layout once. Large tables are Parquet, partitioned by a
column of few values; CSV is for the hand-over to tools outside Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.global_ml import GlobalModel


def write_accuracy(accuracy: DataFrame, path: str, run_id: str) -> None:
    """Accuracy table of a run; other runs in the same place are kept."""
    (
        accuracy.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def write_comparison(comparison: DataFrame, path: str) -> None:
    """Comparison table as CSV with header."""
    comparison.write.mode("overwrite").option("header", True).csv(path)


def write_forecasts(forecasts: DataFrame, path: str) -> None:
    """Forecast table by model; rebalancing gives each model a few full files and splits a large one."""
    forecasts.hint("rebalance", "model_id").write.mode("overwrite").partitionBy("model_id").parquet(path)


def write_handover(panel: DataFrame, path: str) -> None:
    """``id, date, value`` as CSV for a model outside Spark, each file sorted."""
    rows = panel.select("id", "date", "value").repartition("id").sortWithinPartitions("id", "date")
    rows.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_tuning(metrics: DataFrame, best: DataFrame, path: str) -> None:
    """Tuning scores and the chosen parameters side by side."""
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/results")
    best.write.mode("overwrite").option("header", True).csv(f"{path}/best")


def save_model(model: GlobalModel, path: str) -> None:
    """Global model: the levels of its series and a Spark ML pipeline; ``load_global`` reads both."""
    model.save(path)


def save_series_models(fits: DataFrame, path: str) -> None:
    """Parameters of the per-series models, one row per id and model."""
    one_each = fits.filter("step = 1").select("id", "model_id", "variant", "params", "status")
    one_each.write.mode("overwrite").parquet(path)
