"""All named queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from vocalith.plans import gates, manifests, measures, sequences, streams, upkeep  # noqa: F401
from vocalith.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
