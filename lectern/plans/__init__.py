"""The engine's queries: importing this package fills the registry."""

from . import catalogue, details, fulltext, graph, ingest, intelligence, nearness, reading, relational, retrieval, scalars, surfacing  # noqa: F401
from .registry import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
