"""All graph queries and their SQL."""

from __future__ import annotations

from weftgraph.plans import answers, code, diagrams, flows, model  # noqa: F401  (registers its queries)
from weftgraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
