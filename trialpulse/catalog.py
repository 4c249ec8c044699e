"""Registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from .queries import ORACLES, QUERIES

FLAGSHIP = "dqi_risk"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
