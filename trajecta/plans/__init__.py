"""Registered queries over the driver's tables, with their oracles, and the fitted pipeline."""

from trajecta.plans import layers, mining, scalars, sequence  # noqa: F401
from trajecta.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
