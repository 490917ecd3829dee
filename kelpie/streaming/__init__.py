"""Structured Streaming forms of the ingest and maintenance jobs."""
