"""All registered queries."""

from gridloom.plans import candidates, compositions, evaluation, filters, graphs, profiles, rasters, regions  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
