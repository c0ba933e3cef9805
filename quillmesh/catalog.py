"""All queries of the core library, by name, with the SQL that DuckDB checks them against."""

from __future__ import annotations

from importlib import import_module

from quillmesh.plans.base import Query

MODULES = ("text_queries", "ranking_queries", "record_queries", "document_queries", "claim_queries", "stream_queries", "report_queries", "page_queries", "gate_queries", "store_queries", "draft_queries")
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _registry = import_module(f"quillmesh.plans.{_name}").REGISTRY
    QUERIES |= _registry.queries
    ORACLES |= _registry.oracles
