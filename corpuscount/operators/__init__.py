"""Counting jobs, comparison, layout, statistics, scaling and fleet operators."""
