"""The registered queries: see registry.QUERIES and registry.ORACLES."""

from . import source_queries, text_queries, vector_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
