"""All named queries and their oracles."""

from __future__ import annotations

from ledgerscope.plans import (  # noqa: F401
    cleaning_queries,
    dashboard_queries,
    enrichment_queries,
    evaluation_queries,
    learning_queries,
    source_queries,
)
from ledgerscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
