from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelweave.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", 8)


def month(i: int) -> dt.date:
    """First day of the i-th month from January 2010."""
    return dt.date(2010 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="session")
def make_panel(spark):
    """Panel from ``{id: {month number: value}}`` or ``{id: [values]}``."""

    def build(series: dict):
        rows = []
        for key, values in series.items():
            pairs = values.items() if isinstance(values, dict) else enumerate(values)
            rows += [(key, month(i), None if v is None else float(v)) for i, v in pairs]
        return spark.createDataFrame(rows, "id string, date date, value double")

    return build


@pytest.fixture(scope="session")
def values_of():
    """``{id: [value by date]}`` of a panel."""

    def collect(df, column: str = "value"):
        out: dict[str, list] = {}
        for r in df.orderBy("id", "date").collect():
            out.setdefault(r["id"], []).append(r[column])
        return out

    return collect
