"""Daily and weekday traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import weekday_number

# The day-of-month lists of a month of exactly four of each weekday end here.
PARITY_LAST_DAY = 28


def project_day(df: DataFrame, ts: str = "time") -> DataFrame:
    return df.select(F.dayofmonth(ts).alias("day"))


def daily_requests(df: DataFrame, ts: str = "time", by: str = "date") -> DataFrame:
    """Requests per calendar ``date``, or per ``day`` of the month (which merges months)."""
    if by not in ("date", "day"):
        raise ValueError(f"by must be 'date' or 'day', not {by!r}")
    key = F.to_date(ts) if by == "date" else F.dayofmonth(ts)
    # Partial aggregation leaves one row per day and task, so a busy day is no hot key.
    return df.groupBy(key.alias(by)).agg(F.count(F.lit(1)).alias("total_reqs"))


def sort_daily(daily: DataFrame) -> DataFrame:
    """Order daily totals by their day."""
    return daily.orderBy("date" if "date" in daily.columns else "day")


def number_weekdays(daily: DataFrame) -> DataFrame:
    """Add the true weekday number (Monday = 1) of ``date``."""
    return daily.withColumn("weekday", weekday_number("date"))


def weekday_extremes(daily: DataFrame, parity_days: bool = False) -> DataFrame:
    """(weekday, min_reqs, max_reqs) over the daily totals, in one aggregation.

    ``parity_days`` leaves out the days after the 28th of each month.
    """
    if parity_days:
        daily = daily.where(F.dayofmonth("date") <= PARITY_LAST_DAY)
    # NULL dates are lines without a readable time; they belong to no weekday.
    return (
        number_weekdays(daily.where(F.col("date").isNotNull()))
        .groupBy("weekday")
        .agg(F.min("total_reqs").alias("min_reqs"), F.max("total_reqs").alias("max_reqs"))
    )


def extremes_long(extremes: DataFrame) -> DataFrame:
    """(weekday, stat, value): the table behind a min/max figure."""
    return extremes.select(
        "weekday", F.col("min_reqs").alias("min"), F.col("max_reqs").alias("max")
    ).unpivot("weekday", ["min", "max"], "stat", "value")


def bool_share(df: DataFrame, predicate: Column, name: str = "matches") -> DataFrame:
    """Requests for each outcome of ``predicate``."""
    return df.groupBy(predicate.alias(name)).agg(F.count(F.lit(1)).alias("total_reqs"))


def requests_per_host(df: DataFrame, ts: str = "time", host: str = "host", rsd: float | None = None) -> DataFrame:
    """Per date: requests, distinct hosts and requests per host.

    Exact by default: Spark first aggregates on (date, host), so a busy day is spread over its
    hosts. ``rsd`` asks for the approximate count with that relative deviation, without that shuffle.
    Lines whose host was not found (``''`` or NULL) count in neither number; parse with ``any_host``
    to have hosts without a dot as well.
    """
    df = df.where(F.col(host) != "")
    hosts = F.count_distinct(host) if rsd is None else F.approx_count_distinct(host, rsd)
    return (
        df.groupBy(F.to_date(ts).alias("date"))
        .agg(F.count(F.lit(1)).alias("total_reqs"), hosts.alias("total_hosts"))
        .withColumn("avg_reqs", F.try_divide("total_reqs", "total_hosts"))
    )
