"""Ordered multi-model selections on Spark."""

from .lang.session import Session
from .operators.selection import Aggregation, GroupedSelection, Selection
from .sources.catalog import Engine

__all__ = ["Aggregation", "Engine", "GroupedSelection", "Selection", "Session"]
