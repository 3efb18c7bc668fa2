"""Panels over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.steps import DAY, MONTH
from panelweave.operators.panel import MONEY_SCALE, bucket_sum, bucket_sum_by_attribute, regular_panel
from panelweave.session import materialize
from panelweave.sources.tables import read_table

# Rules for the event log in the form of functions.labels.PRODUCTION_RULES.
EVENT_RULES = (("click|view", "engagement"), ("purchase|signup", "conversion"))


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped lines as raw observations."""
    return read_table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def part_month(spark: SparkSession, sf: str, attribute: str, part: DataFrame | None = None) -> DataFrame:
    """Monthly revenue by a part attribute."""
    part = read_table(spark, sf, "part") if part is None else part
    return bucket_sum_by_attribute(
        shipments(spark, sf), part, ("l_partkey", "p_partkey"), attribute, "l_shipdate", "l_extendedprice", MONTH, MONEY_SCALE
    )


def brand_month(spark: SparkSession, sf: str) -> DataFrame:
    """PM: revenue by brand and month."""
    return part_month(spark, sf, "p_brand")


def type_month(spark: SparkSession, sf: str) -> DataFrame:
    """PT: revenue by part type and month."""
    return part_month(spark, sf, "p_type")


def supplier_month(spark: SparkSession, sf: str) -> DataFrame:
    """PS: revenue by supplier and month; the number of series grows with the data."""
    supplier = F.col("l_suppkey").cast("string").alias("id")
    return bucket_sum(shipments(spark, sf), [supplier], "l_shipdate", "l_extendedprice", MONTH, MONEY_SCALE)


def user_day(spark: SparkSession, sf: str) -> DataFrame:
    """PD: event value by user and day."""
    user = F.col("user_id").cast("string").alias("id")
    return bucket_sum(read_table(spark, sf, "events"), [user], "ts", "value", DAY, MONEY_SCALE)


def lazy(spark: SparkSession, sf: str, panel: str) -> DataFrame:
    """A gap-free panel as a plan, for a single reader."""
    build = {"PM": brand_month, "PT": type_month, "PS": supplier_month, "PD": user_day}[panel]
    freq = DAY if panel == "PD" else MONTH
    return regular_panel(build(spark, sf), freq).select("id", "date", "value")


def regular(spark: SparkSession, sf: str, panel: str) -> DataFrame:
    """A gap-free panel, written once because its users read it more than once."""
    return materialize(lazy(spark, sf, panel), f"panel_{panel}")
