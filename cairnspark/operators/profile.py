"""Table profiles: every function is one pass and returns a result of fixed size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape(df: DataFrame) -> DataFrame:
    """One row: (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"))


def null_profile(df: DataFrame) -> DataFrame:
    """One row: for every column, how many of its values are NULL."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def describe_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, stddev, min and max as text rows; mean and stddev of a text column are NULL."""
    return df.describe(*cols)


def numeric_summary(df: DataFrame, col: str) -> DataFrame:
    """One row: min, max, mean, sample standard deviation and count of ``col``."""
    return df.agg(
        F.min(col).alias(f"min_{col}"),
        F.max(col).alias(f"max_{col}"),
        F.avg(col).alias(f"mean_{col}"),
        F.stddev_samp(col).alias(f"std_{col}"),
        F.count(col).alias(f"count_{col}"),
    )
