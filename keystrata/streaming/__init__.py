"""Streaming ingest of change logs."""
