"""Imports every module that registers queries."""

from __future__ import annotations

from foliant.plans import chunk_queries, evaluation_queries, glossary_queries, graph_queries, relational_queries, retrieval_queries, stream_queries, text_queries  # noqa: F401
from foliant.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
