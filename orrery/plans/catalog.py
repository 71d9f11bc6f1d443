"""All queries of the engine."""

from orrery.plans import extras, flows, scores  # noqa: F401
from orrery.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
