"""Reproducible hash buckets, equal in every engine that has md5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(keys: Sequence[str], buckets: int, salt: str) -> Column:
    """A bucket 0 .. ``buckets`` - 1 from the first 32 bits of md5 over ``salt`` and the keys joined by ``-``.

    A pure function of the row: no shuffle, the same bucket after a task is run again. Buckets of
    different salts are independent, so a sample of one part of a split keeps its share.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")
    digest = F.md5(F.concat_ws("-", F.lit(salt), *[F.col(k).cast("string") for k in keys]))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(buckets)).cast("int")
