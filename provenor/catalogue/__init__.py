"""Registered queries with their SQL counterparts, grouped like the operators."""

from provenor.catalogue import (  # noqa: F401
    aggregates,
    filters,
    functions,
    joins,
    quality,
    retrieval,
    scoring,
    shape,
    sinks,
    sorting,
    sources,
    steps,
    windows,
)
from provenor.catalogue.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
