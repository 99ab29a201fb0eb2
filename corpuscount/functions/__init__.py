"""Columns: tokens, checksums, text forms and scaling laws."""
