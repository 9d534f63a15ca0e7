"""The registered queries."""

from . import finding, layouts, loading, series, stores, streams  # noqa: F401  (fill the registry)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
