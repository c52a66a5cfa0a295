"""Compaction plans."""
