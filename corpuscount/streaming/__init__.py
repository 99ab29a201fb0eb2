"""Incremental word counts."""
