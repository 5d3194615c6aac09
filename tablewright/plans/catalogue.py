"""All queries over the driver's tables by name, each beside its SQL twin."""

from __future__ import annotations

from . import diagnostic_queries, discovery_queries, evidence_queries, regime_queries, rule_queries  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
