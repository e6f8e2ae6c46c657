"""Counts per key, the k most and least frequent keys, and exact shares of keys at any scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.sources.tables import materialise

# Sampled keys used to find the cut of a share: the slice with the cut holds about this part of all keys.
KEY_SLICES = 4096


def endpoint_counts(df: DataFrame, key: str = "endpoint") -> DataFrame:
    """(key, count). A hot key shrinks to one row per task before the shuffle."""
    return df.groupBy(key).count()


def extreme_k(
    counts: DataFrame, k: int = 12, largest: bool = True, key: str = "endpoint", where: Column | None = None
) -> DataFrame:
    """The ``k`` keys with the largest (smallest) ``count``; equal counts go by key, ascending."""
    if where is not None:
        counts = counts.where(where)
    return counts.orderBy(F.col("count").desc() if largest else F.col("count"), key).limit(k)


def limit_sample(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``keys``."""
    return df.orderBy(*keys).limit(n)


def rank_in_group(
    df: DataFrame, group: str | Sequence[str], order_by: Sequence[str | Column], k: int, name: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every group with their rank.

    Spark keeps at most ``k`` rows per group and task before the shuffle, so a group that holds a
    large share of all rows does not reach one task whole.
    """
    groups = [group] if isinstance(group, str) else list(group)
    window = Window.partitionBy(*groups).orderBy(*order_by)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def endpoint_long(top: DataFrame, bottom: DataFrame, key: str = "endpoint") -> DataFrame:
    """(group, rank, endpoint, count): the table behind a figure of both k-row lists."""

    def ranked(part: DataFrame, group: str, count_order: Column) -> DataFrame:
        window = Window.partitionBy("group").orderBy(count_order, key)
        return part.select(F.lit(group).alias("group"), key, "count").withColumn(
            "rank", F.row_number().over(window)
        )

    both = ranked(top, "top", F.col("count").desc()).unionByName(ranked(bottom, "bottom", F.col("count")))
    return both.select("group", "rank", key, "count")


def extreme_share(
    counts: DataFrame,
    share: float = 0.1,
    largest: bool = True,
    key: str = "user_id",
    count: str = "n_ratings",
    by: str | None = None,
    slices: int = KEY_SLICES,
) -> DataFrame:
    """The floor(``share`` × keys) keys with the most (fewest) counts; equal counts go by key, ascending.

    ``counts`` has one row per key, or per (``by``, key) where ``by`` has few values, such as a fold.
    It is written once to shared storage, as it is read twice; use ``share_of_stored`` if it is a table.

    A NULL key is a key like any other, the last one of its count. Rows with a NULL ``by`` or count are left out.
    """
    return share_of_stored(materialise(counts, "counts"), share, largest, key, count, by, slices)


def share_of_stored(
    counts: DataFrame,
    share: float = 0.1,
    largest: bool = True,
    key: str = "user_id",
    count: str = "n_ratings",
    by: str | None = None,
    slices: int = KEY_SLICES,
) -> DataFrame:
    """``extreme_share`` of a stored table, in two passes over it and without a sort of all keys.

    1. A sample of about ``slices`` rows, by the hash of the key, and the number of keys of each
       ``by``. The sampled (count, key) pairs are quantiles: those five standard deviations below
       and above the share enclose the cut, those in between divide the enclosed keys into slices.
    2. The rows up to the upper bound, about the share, are written with their slice.

    The sizes of the slices show which one holds the last wanted key, and only that one is sorted.
    Should the cut lie beyond the upper bound after all, pass 2 runs again without it.

    What is broadcast is the sample, or one row per slice: bounded by ``slices``, not by the data.
    """
    columns, n = counts.columns, counts.count()  # the files' footers hold the count
    group = by or "_all"
    rows = counts.dropna(subset=[count, *([by] if by else [])])
    if not by:
        rows = rows.withColumn(group, F.lit(0))
    # A pair of structs compares field by field; isnull puts a NULL key behind the others.
    at = F.struct((-F.col(count) if largest else F.col(count)).alias("n"), F.isnull(key).alias("last"), F.col(key).alias("key"))
    sampled = F.pmod(F.xxhash64(key, F.lit("share")), F.lit(max(1, n // slices))) == 0
    middle = F.col("_take") / F.col("_n")
    spread = 5 * F.sqrt(F.size("_sample") * middle * (1 - middle)) + 5
    first = F.greatest(F.floor(middle * F.size("_sample") - spread), F.lit(0)).cast("int")
    last = F.ceil(middle * F.size("_sample") + spread).cast("int")
    marks = (
        rows.groupBy(group)
        .agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.when(sampled, at))).alias("_sample"))
        .withColumn("_take", F.floor(F.col("_n") * F.lit(float(share))))
        .where("_take > 0")
        .select(
            group,
            "_take",
            F.slice("_sample", first + 1, last - first + 1).alias("_bounds"),
            (last >= F.size("_sample")).alias("_open"),
        )
    )
    marks = materialise(marks, "share-marks")

    def candidates(bounded: bool) -> DataFrame:
        below = F.when(at < F.get("_bounds", F.lit(0)), 0).otherwise(F.size(F.filter("_bounds", lambda b: b <= at)))
        found = rows.join(F.broadcast(marks), group)
        if bounded:
            found = found.where(F.col("_open") | (at < F.try_element_at("_bounds", F.lit(-1))))
        return materialise(found.select(*rows.columns, "_take", below.alias("_slice")), "share-candidates")

    found = candidates(bounded=True)
    enough = found.groupBy(group).agg((F.count(F.lit(1)) >= F.max("_take")).alias("enough"))
    if marks.join(enough, group, "left").where(~F.coalesce("enough", F.lit(False))).limit(1).count():
        found = candidates(bounded=False)

    upto = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    sizes = (
        found.groupBy(group, "_slice", "_take")
        .agg(F.count(F.lit(1)).alias("_have"))
        .withColumn("_nth", F.col("_take") - (F.sum("_have").over(upto) - F.col("_have")))
        .where("_nth > 0")
        .drop("_take")
    )
    placed = found.join(F.broadcast(sizes), [group, "_slice"])
    position = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(at))
    cut = placed.where("_nth < _have").withColumn("_position", position).where("_position <= _nth")
    return placed.where("_nth >= _have").select(*columns).unionByName(cut.select(*columns))
