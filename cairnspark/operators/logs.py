"""Parsing, rejecting and cleaning of access-log lines."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import clf

LOG_FIELDS = ("host", "timestamp", "method", "endpoint", "protocol", "status", "content_size")


def parse_clf(
    df: DataFrame,
    col: str = "value",
    blank_to_null: bool = False,
    keep: Sequence[str] = (),
    any_zone: bool = False,
    any_host: bool = False,
) -> DataFrame:
    """The seven log fields of each line, each found by its own pattern.

    A text field whose pattern does not match is ``''`` (NULL with ``blank_to_null``); ``status``
    and ``content_size`` are NULL. The status is the first three-digit word of the line, so a
    request that itself holds one wins over the real code: ``parse_clf_split`` goes by position.
    ``keep`` names further input columns to carry along. Times with a ``+`` zone are found with
    ``any_zone`` only, hosts without a dot with ``any_host`` only.
    """
    text = {
        "host": F.regexp_extract(col, r"^(\S++)\s" if any_host else clf.HOST_PATTERN, 1),
        "timestamp": F.regexp_extract(col, clf.ANY_ZONE_TIME_PATTERN if any_zone else clf.TIME_PATTERN, 1),
        "method": F.regexp_extract(col, clf.REQUEST_PATTERN, 1),
        "endpoint": F.regexp_extract(col, clf.REQUEST_PATTERN, 2),
        "protocol": F.regexp_extract(col, clf.REQUEST_PATTERN, 3),
    }
    if blank_to_null:
        text = {name: F.nullif(field, F.lit("")) for name, field in text.items()}
    return df.select(
        *keep,
        *[field.alias(name) for name, field in text.items()],
        F.regexp_extract(col, clf.STATUS_PATTERN, 1).try_cast("int").alias("status"),
        F.regexp_extract(col, clf.SIZE_PATTERN, 1).try_cast("bigint").alias("content_size"),
    )


def parse_clf_split(df: DataFrame, col: str = "value") -> DataFrame:
    """Five fields of a line; reply code and bytes are the last two blank-separated words. Drops ``col``."""
    words = F.split(col, " ")
    return df.withColumns(
        {
            "host": F.regexp_extract(col, clf.SPLIT_HOST_PATTERN, 1),
            "timestamp": F.regexp_extract(
                F.regexp_extract(col, clf.SPLIT_TIME_END_PATTERN, 1), clf.SPLIT_TIME_PATTERN, 1
            ),
            "request": F.regexp_extract(col, clf.SPLIT_REQUEST_PATTERN, 1),
            "HTTP reply code": F.try_element_at(words, F.lit(-2)).try_cast("int"),
            "bytes in the reply": F.try_element_at(words, F.lit(-1)).try_cast("bigint"),
        }
    ).drop(col)


def fill_content_size(df: DataFrame) -> DataFrame:
    """0 for a missing size."""
    return df.na.fill({"content_size": 0})


def status_present(df: DataFrame) -> DataFrame:
    return df.where(F.col("status").isNotNull())


def with_time(df: DataFrame, honour_zone: bool = False) -> DataFrame:
    """Replace the text column ``timestamp`` by the timestamp column ``time``."""
    return df.withColumn("time", clf.clf_time("timestamp", honour_zone)).drop("timestamp")


def clean_logs(df: DataFrame, honour_zone: bool = False) -> DataFrame:
    """Parsed log → rows with a status, sizes filled, ``time`` in place of ``timestamp``."""
    return with_time(fill_content_size(status_present(df)), honour_zone)


def null_lines(df: DataFrame, col: str = "value") -> DataFrame:
    return df.where(F.col(col).isNull())


def bad_rows(df: DataFrame, cols: Sequence[str] = LOG_FIELDS) -> DataFrame:
    """Rows with a NULL in any of ``cols``."""
    return df.where(reduce(or_, [F.col(c).isNull() for c in cols]))


def unmatched(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Rows whose ``col`` holds no match of ``pattern``; a NULL is neither matched nor unmatched."""
    return df.where(~F.col(col).rlike(pattern))


def lines_without_status(df: DataFrame, col: str = "value") -> DataFrame:
    return unmatched(df, col, clf.STATUS_PATTERN)


def lines_without_size(df: DataFrame, col: str = "value") -> DataFrame:
    return unmatched(df, col, clf.SIZE_PATTERN)


def rejects(df: DataFrame, col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The lines without a status, parsed as far as they go."""
    return parse_clf(lines_without_status(df, col), col, keep=keep)


def in_days(df: DataFrame, days: Iterable[int], ts: str = "time") -> DataFrame:
    """Rows whose day of the month is one of ``days``."""
    return df.where(F.dayofmonth(ts).isin(*days))


def endpoint_contains(df: DataFrame, text: str, col: str = "endpoint") -> DataFrame:
    """Literal, case-sensitive, anywhere in the endpoint."""
    return df.where(F.col(col).contains(text))


def _glob_to_like(glob: str) -> str:
    quoted = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return quoted.replace("*", "%").replace("?", "_")


def endpoint_matches(
    df: DataFrame, patterns: Sequence[str], col: str = "endpoint", syntax: str = "glob"
) -> DataFrame:
    """Rows whose endpoint matches any of ``patterns``.

    ``glob`` patterns (``*.gif``) cover the whole endpoint and become LIKE, which Catalyst turns
    into plain prefix, suffix or substring tests. ``regex`` patterns may match anywhere.
    """
    if not patterns:
        raise ValueError("at least one pattern is needed")
    if syntax == "glob":
        return df.where(reduce(or_, [F.col(col).like(_glob_to_like(p)) for p in patterns]))
    if syntax == "regex":
        return df.where(F.col(col).rlike("|".join(f"(?:{p})" for p in patterns)))
    raise ValueError(f"unknown pattern syntax: {syntax}")
