"""Every registered query with a SQL twin, compared row by row on the small tables."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry
from panelweave.plans import catalog
from tools.check_twins import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, con, name):
    ok, note = compare(spark, con, name, SF_DIR)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL_TWINS)))
def test_without_twin(spark, name):
    """Queries that SQL cannot express: rows under the schema they declare, a finite number wherever they predict."""
    table = catalog.QUERIES[name](spark, SF_DIR)
    rows = table.collect()
    assert rows
    if "prediction" in table.columns:
        known = [r for r in rows if "status" not in table.columns or r["status"] == "ok"]
        assert known and all(r["prediction"] is not None and math.isfinite(r["prediction"]) for r in known)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
