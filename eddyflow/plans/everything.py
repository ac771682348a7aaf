"""All queries: importing this module registers every one of them."""

from eddyflow.plans import changes, front, functions, relational, sources, streams, surface, timejoins, windows  # noqa: F401
from eddyflow.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
