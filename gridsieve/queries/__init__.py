"""Registered queries, one module per operator family."""

from gridsieve.queries.common import ORACLES, QUERIES
from gridsieve.queries import (  # noqa: F401
    aggregates,
    curation,
    io,
    lookups,
    models,
    neighbors,
    screening,
    windows,
)

__all__ = ["ORACLES", "QUERIES"]
