"""The named queries on the test tables, and their SQL twins."""

from cairnspark.plans import classification, logs, ratings  # noqa: F401  (they register their queries)
from cairnspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
