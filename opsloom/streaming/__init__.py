"""Structured Streaming forms of the audit, metric and ingest operators."""
