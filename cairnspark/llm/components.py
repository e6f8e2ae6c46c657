"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.sources.tables import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (``large``) or the smaller neighbours of each node onto the least node around it."""
    ways = edges.union(edges.select("b", "a")) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = ways.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("top"))
    met = ways.join(least, ways.a == least.node)
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("top").alias("b"))
    else:
        moved = met.select("b", "top").union(least.select("node", "top")).toDF("a", "b")
    return moved.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edge columns ``a`` and ``b``; the component is its least node.

    Each round is written to shared storage, so a lost executor costs one round at most. A node of
    many edges is no trouble: minima are combined before the shuffle and joins on it can be split.
    Nodes are numbers. Loops and repeated edges change nothing; no edge gives no row.
    """
    held = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = _state(held)
    while state[0]:
        held = materialise(_star(_star(held, large=True), large=False), "edges")
        now = _state(held)
        if now == state:
            break
        state = now
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(held.select("b", "b").distinct())
