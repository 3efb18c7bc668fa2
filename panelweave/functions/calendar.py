"""Calendar signature of a date as integer columns and text labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALENDAR_NUMERIC = (
    "date_index_num", "date_year", "date_half", "date_quarter", "date_month", "date_day",
    "date_wday_sun1", "date_mday", "date_qday", "date_yday", "date_mweek", "date_week",
    "date_week2", "date_week3", "date_week4", "date_mday7",
)
CALENDAR_LABELS = ("date_month_lbl", "date_wday_lbl")
SCALED_COLUMNS = ("date_index_num", "date_year")


def calendar_columns(date: Column) -> dict[str, Column]:
    """Named calendar expressions of ``date``; weekday 1 is Sunday."""
    week = F.floor((F.dayofyear(date) - 1) / 7) + 1
    qstart = F.trunc(date, "quarter")
    sunday_weeks = F.dayofmonth(date) + F.dayofweek(F.trunc(date, "month")) + 5
    numeric = {
        "date_index_num": F.unix_date(date).cast("bigint") * 86400,
        "date_year": F.year(date),
        "date_half": F.when(F.month(date) <= 6, 1).otherwise(2),
        "date_quarter": F.quarter(date),
        "date_month": F.month(date),
        "date_day": F.dayofmonth(date),
        "date_wday_sun1": F.dayofweek(date),
        "date_mday": F.dayofmonth(date),
        "date_qday": F.date_diff(date, qstart) + 1,
        "date_yday": F.dayofyear(date),
        "date_mweek": F.floor(sunday_weeks / 7),
        "date_week": week,
        "date_week2": F.pmod(week, F.lit(2)),
        "date_week3": F.pmod(week, F.lit(3)),
        "date_week4": F.pmod(week, F.lit(4)),
        "date_mday7": F.floor(F.dayofmonth(date) / 7) + 1,
    }
    columns = {name: expr.cast("bigint") for name, expr in numeric.items()}
    columns["date_month_lbl"] = F.date_format(date, "MMMM")
    columns["date_wday_lbl"] = F.date_format(date, "EEEE")
    return columns


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """``df`` plus its calendar signature."""
    return df.withColumns(calendar_columns(F.col(date)))
