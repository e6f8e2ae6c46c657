"""Samples, hold-outs and folds. The keyed forms are pure functions of the row: no shuffle, repeatable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.functions import hash_bucket
from cairnspark.operators.relational import union_all

#: Fixed value: the published seed.
SEED = 8744
#: Salts of the keyed forms. They differ, so that a sample, a hold-out and folds on one key are independent.
SAMPLE, HOLDOUT, FOLDS = "sample", "holdout", "folds"


def _threshold(fraction: float, resolution: int) -> int:
    threshold = round(fraction * resolution)
    if not 0 <= fraction <= 1 or abs(threshold - fraction * resolution) > 1e-9:
        raise ValueError(f"{fraction} is no share in steps of 1/{resolution}")
    return threshold


def hash_sample(
    df: DataFrame,
    keys: Sequence[str] | None,
    fraction: float,
    resolution: int = 100,
    seed: int = SEED,
    salt: str = SAMPLE,
) -> DataFrame:
    """The rows whose key hash falls into the first ``fraction`` of buckets; without ``keys`` a seeded random sample."""
    if keys is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.where(hash_bucket(keys, resolution, salt) < _threshold(fraction, resolution))


def holdout(
    df: DataFrame,
    keys: Sequence[str] | None,
    test: float = 0.2,
    resolution: int = 100,
    seed: int = SEED,
    salt: str = HOLDOUT,
) -> DataFrame:
    """Add ``part``: ``test`` for that share of the rows, else ``train``.

    Without ``keys`` by a seeded random number; that one depends on the order of the rows, so store
    the result before using both parts.
    """
    if keys is None:
        in_test = F.rand(seed) < test
    else:
        in_test = hash_bucket(keys, resolution, salt) < _threshold(test, resolution)
    return df.withColumn("part", F.when(in_test, "test").otherwise("train"))


def assign_folds(df: DataFrame, keys: Sequence[str], k: int = 5, salt: str = FOLDS) -> DataFrame:
    """Add ``fold`` 0 .. k-1 from the key hash."""
    return df.withColumn("fold", hash_bucket(keys, k, salt))


def training_part(folded: DataFrame, fold: int, k: int = 5) -> DataFrame:
    """Bag union of all folds but ``fold``; on a table stored by fold, each part reads its own directory."""
    return union_all([folded.where(F.col("fold") == f) for f in range(k) if f != fold])


def fold_sizes(df: DataFrame, fold: str = "fold") -> DataFrame:
    """(fold, n_train, n_test)."""
    sizes = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n_test"))
    # The window spans the few rows of the fold counts.
    total = F.sum("n_test").over(Window.partitionBy(F.lit(1)))
    return sizes.select(fold, (total - F.col("n_test")).alias("n_train"), "n_test")


def split_counts(df: DataFrame, part: str = "part") -> DataFrame:
    """Rows per part."""
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("n_rows"))
