"""Incremental forms of evidence operators."""
