"""Scalar expressions and statistics."""
