"""Registered queries on the driver's tables, each with its SQL oracle where SQL can express it."""

from .registry import ORACLES, QUERIES
from . import content, evidence, extraction, folds, history, memory, relational, retrieval, runs, scalars, streams  # noqa: F401  they register themselves

__all__ = ["ORACLES", "QUERIES"]
