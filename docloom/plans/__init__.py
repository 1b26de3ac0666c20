"""Queries over the test tables, with their SQL."""

from .reference import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
