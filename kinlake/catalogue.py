"""Every query and its SQL."""

from __future__ import annotations

from kinlake import queries, queries_pairs  # noqa: F401
from kinlake.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
