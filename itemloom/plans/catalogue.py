"""Importing this module registers every query."""

from itemloom.plans import browse, drawing, journals, outlines, searching, statistics, tables  # noqa: F401
from itemloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
