"""Forecasts made outside, brought into the common forecast table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.ranking import first_present

# Column names an outside forecast may use, in order of preference.
PREDICTION_NAMES = ("predictions", "prediction", "0.5")
LOWER_NAME, UPPER_NAME = "0.1", "0.9"


def external_forecasts(df: DataFrame, model_id: str, names: Sequence[str] = PREDICTION_NAMES) -> DataFrame:
    """``(model_id, id, date, prediction[, lo, hi])`` from whichever known column is present."""
    found = first_present(df, names)
    out = [
        F.lit(model_id).alias("model_id"),
        F.col("id"),
        F.to_date("date").alias("date"),
        F.col(f"`{found}`").cast("double").alias("prediction"),
    ]
    for name, alias in ((LOWER_NAME, "lo"), (UPPER_NAME, "hi")):
        if name in df.columns:
            out.append(F.col(f"`{name}`").cast("double").alias(alias))
    return df.select(*out)
