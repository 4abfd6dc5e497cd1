"""Queries over the benchmark tables, with the same results stated in SQL."""
