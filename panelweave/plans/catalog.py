"""All registered queries."""

from __future__ import annotations

from panelweave.plans import (  # noqa: F401
    queries_diagnostics,
    queries_features,
    queries_models,
    queries_panel,
    queries_scoring,
    queries_sinks,
)
from panelweave.plans.registry import QUERIES, SQL_TWINS

__all__ = ["QUERIES", "SQL_TWINS"]
