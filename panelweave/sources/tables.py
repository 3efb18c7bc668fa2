"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PANEL_SCHEMA = "id string, date date, value double"
RAW_SCHEMA = "date date, msn string, description string, unit string, value double"
ACCURACY_SCHEMA = (
    "model_id string, model_desc string, type string, mae double, mape double, mase double, "
    "smape double, rmse double, rsq double"
)


class MissingInputError(RuntimeError):
    """An input is absent or holds no rows."""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with header under a declared schema; no inference pass over the data."""
    return (
        spark.read.option("header", True)
        .option("dateFormat", date_format)
        .option("enforceSchema", False)
        .schema(schema)
        .csv(path)
    )


def read_context(spark: SparkSession, path: str) -> DataFrame:
    """``id, date, value`` history written for an outside model."""
    return read_csv(spark, path, PANEL_SCHEMA)


def require_input(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read a CSV that must exist and hold a row; checked before any scoring starts."""
    try:
        df = read_csv(spark, path, schema)
        empty = df.isEmpty()
    except AnalysisException as problem:
        raise MissingInputError(f"input not found: {path}") from problem
    if empty:
        raise MissingInputError(f"input holds no rows: {path}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df`` unchanged, or an error naming ``what`` if it is empty."""
    if df.isEmpty():
        raise MissingInputError(f"no rows in {what}")
    return df


def cast_date(df: DataFrame, source: str, target: str = "date") -> DataFrame:
    """Day of a date-like or timestamp column."""
    return df.withColumn(target, F.to_date(F.col(source)))
