"""Importing this module registers all queries."""

from workload import evidence_queries, graph_queries, ingest_queries, resolution_queries, search_queries, stage_queries, streaming_queries, text_queries  # noqa: F401
