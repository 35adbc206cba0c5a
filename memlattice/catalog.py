"""All registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

from memlattice.plans import analytics, consolidation, documents, ingest, labelling, memory, retrieval, review, streams, structure, training, units, upkeep  # noqa: F401
from memlattice.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "retrieve_ranked"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
