"""Importing this module registers every catalogue query."""

from causeway.plans import alignment_queries, engine_queries, evaluation_queries, facet_queries, graph_queries, risk_queries, text_queries  # noqa: F401
from causeway.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
