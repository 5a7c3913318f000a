"""Composites: store, ingest, retrieval, question answering."""
