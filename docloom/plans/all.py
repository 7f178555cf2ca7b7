"""Imports every module of queries, so that the registry is full."""

from docloom.plans import corpus, search, statistics, streams, trees  # noqa: F401
from docloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
