"""Operators over change logs: views, scans, membership."""
