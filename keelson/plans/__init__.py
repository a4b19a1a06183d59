"""Registered queries; importing this package registers them all."""

from keelson.plans import (  # noqa: F401
    contract_queries,
    corpus_queries,
    history_queries,
    page_queries,
    record_queries,
    search_queries,
    stream_queries,
    structure_queries,
)
from keelson.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
