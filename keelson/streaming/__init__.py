"""Incremental forms of the co-access graph."""
