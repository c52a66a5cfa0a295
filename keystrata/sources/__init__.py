"""Sorted runs and the manifest that names the live ones."""
