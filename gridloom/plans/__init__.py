"""Registered queries, grouped by area."""

from gridloom.plans import catalog, changes, ingest, query  # noqa: F401  (they register)
from gridloom.plans.registry import PLANS

__all__ = ["PLANS"]
