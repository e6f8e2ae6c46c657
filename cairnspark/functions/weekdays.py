"""Weekday numbering, Monday = 1 .. Sunday = 7."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday_number(col: str | Column) -> Column:
    return (F.weekday(col) + 1).cast("int")


def weekday_name(col: str | Column) -> Column:
    """``Mon`` .. ``Sun``."""
    return F.date_format(col, "EEE")
