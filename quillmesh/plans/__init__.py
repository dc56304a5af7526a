"""Registered queries with the SQL that checks them."""

from quillmesh.plans import aggregates, factored, functions, graph, index, lookups, markov, more, parsing, retrieval, search, stored  # noqa: F401
from quillmesh.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
