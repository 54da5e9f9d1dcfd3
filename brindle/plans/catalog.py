"""All queries by name; importing this registers them."""

from brindle.plans import boxes, duplicates, kernels, labels, matching, outliers, profiles, reports  # noqa: F401
from brindle.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
