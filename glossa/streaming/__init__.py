"""Incremental annotation."""
