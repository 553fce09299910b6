"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from leafmill.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
