"""All queries of the library outside `llm`, with their SQL."""

from __future__ import annotations

from sightline.plans import fuse_queries, history_queries, resolve_queries, snapshot_queries, spatial_queries, stream_queries, text_queries  # noqa: F401  (registers on import)
from sightline.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
