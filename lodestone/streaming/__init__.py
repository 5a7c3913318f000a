"""Structured Streaming: incremental ingest and status."""
