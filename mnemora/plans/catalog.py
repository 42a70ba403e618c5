"""All registered queries and their oracles, from the modules of this package."""

from __future__ import annotations

from . import aggregates, curating, graphs, retrieval, scalar, scans, timeline, upkeep  # noqa: F401 - they register
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
