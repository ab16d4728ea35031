"""Named queries over the adapter tables."""

from . import details, retrieval, store, temporal
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "details", "retrieval", "store", "temporal"]
