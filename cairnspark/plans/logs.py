"""Queries on the access log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions import clf_time, file_name
from cairnspark.operators import logs, profile, ranking, traffic
from cairnspark.plans.registry import once, query
from cairnspark.plans.views import MOVIE, log_lines, sql
from cairnspark.sources import fresh_path, materialise, read_log, write_parquet


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stored table (event_id, value), as a log is stored text and not derived per query."""

    def build():
        rows = log_lines(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
        return materialise(rows, "log-lines")

    return once(spark, sf_dir, "log-lines", build)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_clf(lines(spark, sf_dir), keep=["event_id"])


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.clean_logs(parsed(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.daily_requests(cleaned(spark, sf_dir))


def movie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.endpoint_counts(logs.endpoint_contains(cleaned(spark, sf_dir), MOVIE))


def _time_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("time", F.col("time").cast("string"))


def _date_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("string"))


def _nullable_numbers(df: DataFrame, *columns: str) -> DataFrame:
    """Numbers with NULLs as double: pandas has no one form for integers with gaps."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


_PARSED_SQL = """SELECT * REPLACE (CAST(status AS DOUBLE) AS status, CAST(content_size AS DOUBLE) AS content_size)
                 FROM v_parsed"""


# Sources and sinks


@query("scan_log_text", sql("SELECT value FROM v_log", "v_log"))
def scan_log_text(spark, sf_dir):
    path = fresh_path(spark, "access-log")
    log_lines(spark, sf_dir).select("value").write.option("compression", "gzip").text(path)
    return read_log(spark, path, partitions=spark.sparkContext.defaultParallelism)


@query(
    "sink_parquet",
    sql(
        "SELECT event_id, host, endpoint, status, content_size, CAST(time AS VARCHAR) AS time, "
        "CAST(CAST(time AS DATE) AS VARCHAR) AS date FROM v_clean",
        "v_clean",
    ),
)
def sink_parquet(spark, sf_dir):
    path = fresh_path(spark, "clean-log")
    columns = ["event_id", "host", "endpoint", "status", "content_size", "time"]
    rows = cleaned(spark, sf_dir).select(*columns, F.to_date("time").alias("date"))
    write_parquet(rows, path, partition_by=["date"])
    return _date_as_text(_time_as_text(spark.read.schema(rows.schema).parquet(path)))


@query(
    "weekday_extremes_long",
    sql(
        """SELECT CAST(isodow(date) AS INTEGER) AS weekday, 'min' AS stat, min(total_reqs) AS value
           FROM v_daily GROUP BY 1
           UNION ALL
           SELECT CAST(isodow(date) AS INTEGER), 'max', max(total_reqs) FROM v_daily GROUP BY 1""",
        "v_daily",
    ),
)
def weekday_extremes_long(spark, sf_dir):
    return traffic.extremes_long(traffic.weekday_extremes(daily(spark, sf_dir)))


@query(
    "endpoint_extremes_long",
    sql(
        """SELECT * FROM (
             SELECT 'top' AS "group", CAST(row_number() OVER (ORDER BY count DESC, endpoint) AS INTEGER) AS rank,
               endpoint, count FROM v_movies
             UNION ALL
             SELECT 'bottom', CAST(row_number() OVER (ORDER BY count, endpoint) AS INTEGER), endpoint, count
             FROM v_movies) WHERE rank <= 12""",
        "v_clean",
        "v_movies AS (SELECT endpoint, count(*) AS count FROM v_clean WHERE contains(endpoint, '.mpg') GROUP BY 1)",
    ),
)
def endpoint_extremes_long(spark, sf_dir):
    counts = movie_counts(spark, sf_dir)
    return ranking.endpoint_long(ranking.extreme_k(counts, 12), ranking.extreme_k(counts, 12, largest=False))


# Projections and parsing


@query("parse_clf", sql(_PARSED_SQL, "v_parsed"))
def parse_clf(spark, sf_dir):
    return _nullable_numbers(parsed(spark, sf_dir), "status", "content_size")


@query(
    "parse_clf_split",
    """SELECT event_id,
         CASE WHEN event_id % 500 = 0 THEN ''
              WHEN user_id % 10 = 0 THEN 'host' || user_id ELSE 'host' || user_id || '.example.net' END AS host,
         CASE WHEN event_id % 500 = 0 THEN ''
              ELSE strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' -0400' END AS "timestamp",
         CASE WHEN event_id % 500 = 0 THEN ''
              WHEN event_type = 'view' THEN 'GET /video/clip' || (event_id % 97) || '.mpg HTTP/1.0'
              ELSE 'GET /page/' || event_type || ' HTTP/1.0' END AS request,
         CAST(CASE WHEN event_id % 500 = 0 THEN NULL WHEN event_type = 'error' THEN 404 ELSE 200 END
              AS DOUBLE) AS "HTTP reply code",
         CAST(CASE WHEN event_id % 500 = 0 OR event_type = 'error' THEN NULL ELSE event_id % 5000 END
              AS DOUBLE) AS "bytes in the reply"
       FROM events""",
)
def parse_clf_split(spark, sf_dir):
    split = logs.parse_clf_split(lines(spark, sf_dir))
    return _nullable_numbers(split, "HTTP reply code", "bytes in the reply")


@query(
    "parse_clf_time",
    """SELECT event_id,
         CASE WHEN event_id % 500 = 0 THEN NULL
              ELSE CAST(date_trunc('second', ts) AS VARCHAR) END AS time,
         CASE WHEN event_id % 500 = 0 THEN NULL
              ELSE CAST(epoch(date_trunc('second', ts)) + 4 * 3600 AS DOUBLE) END AS zoned_epoch
       FROM events""",
)
def parse_clf_time(spark, sf_dir):
    times = parsed(spark, sf_dir).select(
        "event_id",
        clf_time("timestamp").cast("string").alias("time"),
        F.unix_timestamp(clf_time("timestamp", honour_zone=True)).alias("zoned_epoch"),
    )
    return _nullable_numbers(times, "zoned_epoch")


@query("project_day", sql("SELECT CAST(day(time) AS INTEGER) AS day FROM v_clean", "v_clean"))
def project_day(spark, sf_dir):
    return traffic.project_day(cleaned(spark, sf_dir))


@query(
    "project_rename_drop",
    sql(
        "SELECT event_id, host AS client, endpoint, status, content_size, CAST(time AS VARCHAR) AS time FROM v_clean",
        "v_clean",
    ),
)
def project_rename_drop(spark, sf_dir):
    return _time_as_text(cleaned(spark, sf_dir).withColumnRenamed("host", "client").drop("method", "protocol"))


@query(
    "fill_content_size",
    sql("SELECT event_id, coalesce(content_size, 0) AS content_size FROM v_parsed", "v_parsed"),
)
def fill_content_size(spark, sf_dir):
    return logs.fill_content_size(parsed(spark, sf_dir)).select("event_id", "content_size")


# Filters


@query("filter_null_lines", "SELECT count(*) AS n_lines FROM events WHERE event_id % 500 = 0")
def filter_null_lines(spark, sf_dir):
    # The broken lines of this log stand for missing ones.
    holed = lines(spark, sf_dir).withColumn("value", F.nullif("value", F.lit("garbage")))
    return logs.null_lines(holed).agg(F.count(F.lit(1)).alias("n_lines"))


@query("filter_bad_rows", "SELECT event_id FROM events WHERE event_id % 500 = 0 OR event_type = 'error'")
def filter_bad_rows(spark, sf_dir):
    return logs.bad_rows(parsed(spark, sf_dir)).select("event_id")


@query("filter_no_status", "SELECT event_id, 'garbage' AS value FROM events WHERE event_id % 500 = 0")
def filter_no_status(spark, sf_dir):
    return logs.lines_without_status(lines(spark, sf_dir))


@query("reparse_rejects", sql(f"{_PARSED_SQL} WHERE event_id % 500 = 0", "v_parsed"))
def reparse_rejects(spark, sf_dir):
    return _nullable_numbers(logs.rejects(lines(spark, sf_dir), keep=["event_id"]), "status", "content_size")


@query(
    "filter_status_present",
    """SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS INTEGER) AS status
       FROM events WHERE event_id % 500 <> 0""",
)
def filter_status_present(spark, sf_dir):
    return logs.status_present(parsed(spark, sf_dir)).select("event_id", "status")


@query("filter_no_size", "SELECT event_id FROM events WHERE event_id % 500 = 0 OR event_type = 'error'")
def filter_no_size(spark, sf_dir):
    return logs.lines_without_size(lines(spark, sf_dir)).select("event_id")


@query(
    "filter_day_set",
    """SELECT event_id, CAST(day(ts) AS INTEGER) AS day FROM events
       WHERE event_id % 500 <> 0 AND day(ts) IN (1, 8, 15, 22)""",
)
def filter_day_set(spark, sf_dir):
    return logs.in_days(cleaned(spark, sf_dir), [1, 8, 15, 22]).select("event_id", F.dayofmonth("time").alias("day"))


@query(
    "filter_endpoint_contains",
    """SELECT event_id, '/video/clip' || (event_id % 97) || '.mpg' AS endpoint FROM events
       WHERE event_id % 500 <> 0 AND event_type = 'view'""",
)
def filter_endpoint_contains(spark, sf_dir):
    return logs.endpoint_contains(cleaned(spark, sf_dir), MOVIE).select("event_id", "endpoint")


@query(
    "filter_endpoint_any_pattern",
    sql(
        "SELECT event_id, endpoint FROM v_clean WHERE endpoint LIKE '%.mpg' OR endpoint LIKE '/page/_____'",
        "v_clean",
    ),
)
def filter_endpoint_any_pattern(spark, sf_dir):
    return logs.endpoint_matches(cleaned(spark, sf_dir), ["*.mpg", "/page/?????"]).select("event_id", "endpoint")


# Aggregations


@query("agg_shape", "SELECT count(*) AS n_rows, 7 AS n_cols FROM events")
def agg_shape(spark, sf_dir):
    return profile.shape(logs.parse_clf(lines(spark, sf_dir)))


@query(
    "agg_null_profile",
    sql(
        "SELECT "
        + ", ".join(f'CAST(count(*) - count("{c}") AS BIGINT) AS "{c}"' for c in logs.LOG_FIELDS)
        + " FROM v_parsed",
        "v_parsed",
    ),
)
def agg_null_profile(spark, sf_dir):
    return profile.null_profile(logs.parse_clf(lines(spark, sf_dir)))


@query("agg_daily_requests", sql("SELECT CAST(date AS VARCHAR) AS date, total_reqs FROM v_daily", "v_daily"))
def agg_daily_requests(spark, sf_dir):
    return _date_as_text(traffic.sort_daily(daily(spark, sf_dir)))


@query(
    "agg_weekday_extremes",
    sql(
        """SELECT CAST(isodow(date) AS INTEGER) AS weekday, min(total_reqs) AS min_reqs,
             max(total_reqs) AS max_reqs FROM v_daily GROUP BY 1""",
        "v_daily",
    ),
)
def agg_weekday_extremes(spark, sf_dir):
    return traffic.weekday_extremes(daily(spark, sf_dir))


@query("agg_endpoint_counts", sql("SELECT endpoint, count(*) AS count FROM v_clean GROUP BY 1", "v_clean"))
def agg_endpoint_counts(spark, sf_dir):
    return ranking.endpoint_counts(cleaned(spark, sf_dir))


@query(
    "agg_describe",
    sql(
        """SELECT 'count' AS summary, CAST(count(endpoint) AS VARCHAR) AS endpoint,
             CAST(count(content_size) AS DOUBLE) AS content_size FROM v_clean
           UNION ALL SELECT 'mean', NULL, round(avg(content_size), 6) FROM v_clean
           UNION ALL SELECT 'stddev', NULL, round(stddev_samp(content_size), 6) FROM v_clean
           UNION ALL SELECT 'min', min(endpoint), min(content_size) FROM v_clean
           UNION ALL SELECT 'max', max(endpoint), max(content_size) FROM v_clean""",
        "v_clean",
    ),
)
def agg_describe(spark, sf_dir):
    text = profile.describe_cols(cleaned(spark, sf_dir), ["endpoint", "content_size"])
    return text.withColumn("content_size", F.round(F.col("content_size").cast("double"), 6))


@query(
    "agg_numeric_summary",
    sql(
        """SELECT min(content_size) AS min_content_size, max(content_size) AS max_content_size,
             round(avg(content_size), 6) AS mean_content_size,
             round(stddev_samp(content_size), 6) AS std_content_size,
             count(content_size) AS count_content_size FROM v_clean""",
        "v_clean",
    ),
)
def agg_numeric_summary(spark, sf_dir):
    summary = profile.numeric_summary(cleaned(spark, sf_dir), "content_size")
    return summary.withColumns(
        {c: F.round(c, 6) for c in ("mean_content_size", "std_content_size")}
    )


@query(
    "agg_bool_share",
    """SELECT event_type = 'view' AS matches, count(*) AS total_reqs FROM events
       WHERE event_id % 500 <> 0 GROUP BY 1""",
)
def agg_bool_share(spark, sf_dir):
    return traffic.bool_share(cleaned(spark, sf_dir), F.col("endpoint").contains(MOVIE))


@query(
    "agg_avg_requests_per_host",
    sql(
        """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS total_reqs,
             count(DISTINCT user_id) AS total_hosts, round(count(*) / count(DISTINCT user_id), 6) AS avg_reqs
           FROM v_valid GROUP BY 1""",
        "v_valid AS (SELECT * FROM events WHERE event_id % 500 <> 0)",
    ),
)
def agg_avg_requests_per_host(spark, sf_dir):
    """With hosts by position, so that each host without a dot counts on its own."""
    rows = logs.parse_clf(lines(spark, sf_dir), any_host=True)
    per_day = traffic.requests_per_host(logs.clean_logs(rows))
    return _date_as_text(per_day).withColumn("avg_reqs", F.round("avg_reqs", 6))


# Sort, limit, top-k


def _extreme_sql(key: str, where: str, order: str, k: int) -> str:
    return sql(
        f"""SELECT {key} AS endpoint, count(*) AS count FROM v_clean WHERE {where}
            GROUP BY 1 ORDER BY count {order}, endpoint LIMIT {k}""",
        "v_clean",
    )


@query("topk_endpoints", _extreme_sql("endpoint", "contains(endpoint, '.mpg')", "DESC", 12))
def topk_endpoints(spark, sf_dir):
    return ranking.extreme_k(movie_counts(spark, sf_dir), 12)


@query("bottomk_endpoints", _extreme_sql("endpoint", "contains(endpoint, '.mpg')", "ASC", 12))
def bottomk_endpoints(spark, sf_dir):
    return ranking.extreme_k(movie_counts(spark, sf_dir), 12, largest=False)


@query(
    "topk_file_names",
    """SELECT 'clip' || (event_id % 97) || '.mpg' AS file, count(*) AS count FROM events
       WHERE event_id % 500 <> 0 AND event_type = 'view' GROUP BY 1 ORDER BY count DESC, file LIMIT 12""",
)
def topk_file_names(spark, sf_dir):
    movies = logs.endpoint_contains(cleaned(spark, sf_dir), MOVIE)
    named = movies.select(file_name("endpoint").alias("file"))
    return ranking.extreme_k(ranking.endpoint_counts(named, "file"), 12, key="file")


@query("topk_error_endpoints", _extreme_sql("endpoint", "status <> 200", "DESC", 10))
def topk_error_endpoints(spark, sf_dir):
    failed = cleaned(spark, sf_dir).where(F.col("status") != 200)
    return ranking.extreme_k(ranking.endpoint_counts(failed), 10)


@query(
    "sort_daily",
    sql("SELECT CAST(day(date) AS INTEGER) AS day, CAST(sum(total_reqs) AS BIGINT) AS total_reqs "
        "FROM v_daily GROUP BY 1 ORDER BY 1", "v_daily"),
)
def sort_daily(spark, sf_dir):
    return traffic.sort_daily(traffic.daily_requests(cleaned(spark, sf_dir), by="day"))


@query("limit_sample", sql(f"{_PARSED_SQL} ORDER BY event_id LIMIT 20", "v_parsed"))
def limit_sample(spark, sf_dir):
    rows = ranking.limit_sample(parsed(spark, sf_dir), ["event_id"], 20)
    return _nullable_numbers(rows, "status", "content_size")


# Numbering and ranking


@query(
    "number_weekdays",
    sql(
        "SELECT CAST(date AS VARCHAR) AS date, total_reqs, CAST(isodow(date) AS INTEGER) AS weekday FROM v_daily",
        "v_daily",
    ),
)
def number_weekdays(spark, sf_dir):
    return _date_as_text(traffic.number_weekdays(daily(spark, sf_dir)))


@query(
    "rank_in_group",
    sql(
        """SELECT weekday, endpoint, count, rank FROM (
             SELECT *, CAST(row_number() OVER (PARTITION BY weekday ORDER BY count DESC, endpoint) AS INTEGER) AS rank
             FROM (SELECT CAST(isodow(time) AS INTEGER) AS weekday, endpoint, count(*) AS count
                   FROM v_clean GROUP BY 1, 2)) WHERE rank <= 3""",
        "v_clean",
    ),
)
def rank_in_group(spark, sf_dir):
    counts = traffic.number_weekdays(cleaned(spark, sf_dir).withColumn("date", F.to_date("time")))
    counts = counts.groupBy("weekday", "endpoint").count()
    return ranking.rank_in_group(counts, "weekday", [F.col("count").desc(), "endpoint"], 3)
