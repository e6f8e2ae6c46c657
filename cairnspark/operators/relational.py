"""Bag union and distinct items."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, parts)


def distinct_items(ratings: DataFrame, item: str = "item_id") -> DataFrame:
    return ratings.select(item).distinct()
