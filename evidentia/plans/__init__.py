"""Queries over the driver tables, with SQL counterparts."""

from . import entities, formats, genomics, matrix, networks, roundtrips, rules, screen, selection, statistics  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
