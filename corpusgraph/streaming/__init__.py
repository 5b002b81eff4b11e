"""Structured Streaming versions of the ingest and monitoring operators."""
