"""Readers of splits, parts, logs and tables of machines, and writers of results."""
