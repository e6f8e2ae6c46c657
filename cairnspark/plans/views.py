"""Inputs of the three workloads derived from the test tables, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_FEATURES = 64
MOVIE = ".mpg"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value): an access log with broken lines, hosts without a dot and missing sizes."""
    host = F.concat(F.lit("host"), "user_id", F.when(F.col("user_id") % 10 == 0, "").otherwise(".example.net"))
    path = F.when(
        F.col("event_type") == "view", F.concat(F.lit("/video/clip"), F.col("event_id") % 97, F.lit(MOVIE))
    ).otherwise(F.concat(F.lit("/page/"), "event_type"))
    failed = F.col("event_type") == "error"
    line = F.concat(
        host,
        F.lit(" - - ["),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' -0400] "GET '),
        path,
        F.lit(' HTTP/1.0" '),
        F.when(failed, "404").otherwise("200"),
        F.lit(" "),
        F.when(failed, "-").otherwise((F.col("event_id") % 5000).cast("string")),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 500 == 0, "garbage").otherwise(line).alias("value")
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating), ratings 0.5 to 5 in halves."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").cast("int").alias("user_id"), F.col("l_partkey").cast("int").alias("item_id"))
        .agg((F.ceil(F.max("l_quantity") / 5).cast("double") / 2).alias("rating"))
    )


def tag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, tag_id, score)."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .groupBy(F.col("l_partkey").cast("int").alias("item_id"), F.col("s_nationkey").alias("tag_id"))
        .agg(F.sum("l_quantity").alias("score"))
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag_id, tag)."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tag_id"), F.col("n_name").alias("tag"))


def item_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, cluster): a fixed clustering for exact checks."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("item_id"), (F.col("p_size") % 10).alias("cluster")
    )


def fixed_prediction() -> Column:
    """A prediction that both engines compute, for exact checks of error reports."""
    return F.lit(0.5) + ((F.col("user_id") * 7 + F.col("item_id") * 3) % 10) / F.lit(2.0)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, _c0 .. _c63, _c64): features and a label -1 or 1."""
    vectors = table(spark, sf_dir, "embeddings")
    features = [F.col("embedding")[i].cast("double").alias(f"_c{i}") for i in range(N_FEATURES)]
    label = F.when(F.col("label") >= 5, 1).otherwise(-1).alias(f"_c{N_FEATURES}")
    return vectors.select("vec_id", *features, label)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, _c0 .. _c63, label): as ``wide`` with a learnable label 0 or 1."""
    learnable = F.when(F.col("_c0") + F.col("_c1") > 0, 1).otherwise(0).alias("label")
    return wide(spark, sf_dir).select("*", learnable).drop(f"_c{N_FEATURES}")


# The same inputs for DuckDB, each a WITH item. ``v_parsed`` and ``v_clean`` state the expected
# fields straight from the event, without a line or a pattern.
_HOST = "'host' || user_id || (CASE WHEN user_id % 10 = 0 THEN '' ELSE '.example.net' END)"
_PATH = (
    "(CASE WHEN event_type = 'view' THEN '/video/clip' || (event_id % 97) || '.mpg' "
    "ELSE '/page/' || event_type END)"
)
SQL_VIEWS = {
    "v_log": f"""
        SELECT event_id, CASE WHEN event_id % 500 = 0 THEN 'garbage' ELSE
          {_HOST} || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' -0400] "GET ' || {_PATH}
          || ' HTTP/1.0" ' || (CASE WHEN event_type = 'error' THEN '404' ELSE '200' END) || ' '
          || (CASE WHEN event_type = 'error' THEN '-' ELSE CAST(event_id % 5000 AS VARCHAR) END) END AS value
        FROM events""",
    "v_parsed": f"""
        SELECT event_id,
          CASE WHEN event_id % 500 = 0 OR user_id % 10 = 0 THEN ''
               ELSE 'host' || user_id || '.example.net' END AS host,
          CASE WHEN event_id % 500 = 0 THEN ''
               ELSE strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' -0400' END AS "timestamp",
          CASE WHEN event_id % 500 = 0 THEN '' ELSE 'GET' END AS method,
          CASE WHEN event_id % 500 = 0 THEN '' ELSE {_PATH} END AS endpoint,
          CASE WHEN event_id % 500 = 0 THEN '' ELSE 'HTTP/1.0' END AS protocol,
          CAST(CASE WHEN event_id % 500 = 0 THEN NULL WHEN event_type = 'error' THEN 404 ELSE 200 END
               AS INTEGER) AS status,
          CAST(CASE WHEN event_id % 500 = 0 OR event_type = 'error' THEN NULL ELSE event_id % 5000 END
               AS BIGINT) AS content_size
        FROM events""",
    "v_clean": f"""
        SELECT event_id,
          CASE WHEN user_id % 10 = 0 THEN '' ELSE 'host' || user_id || '.example.net' END AS host,
          'GET' AS method, {_PATH} AS endpoint, 'HTTP/1.0' AS protocol,
          CAST(CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS INTEGER) AS status,
          CAST(CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 5000 END AS BIGINT) AS content_size,
          date_trunc('second', ts) AS time
        FROM events WHERE event_id % 500 <> 0""",
    "v_daily": """
        SELECT CAST(ts AS DATE) AS date, count(*) AS total_reqs
        FROM events WHERE event_id % 500 <> 0 GROUP BY 1""",
    "v_ratings": """
        SELECT CAST(o_custkey AS INTEGER) AS user_id, CAST(l_partkey AS INTEGER) AS item_id,
          CAST(ceil(max(l_quantity) / 5) AS DOUBLE) / 2 AS rating
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "v_folded": """
        SELECT *, CAST(('0x' || substr(md5('folds-' || user_id || '-' || item_id), 1, 8))::BIGINT % 5 AS INTEGER) AS fold
        FROM v_ratings""",
    "v_pred": """
        SELECT *, 0.5::DOUBLE + ((user_id * 7 + item_id * 3) % 10) / 2.0::DOUBLE AS prediction FROM v_folded""",
    "v_scores": """
        SELECT CAST(l_partkey AS INTEGER) AS item_id, s_nationkey AS tag_id, sum(l_quantity) AS score
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey, s_nationkey""",
    "v_tags": "SELECT n_nationkey AS tag_id, n_name AS tag FROM nation",
    "v_clusters": "SELECT CAST(p_partkey AS INTEGER) AS item_id, p_size % 10 AS cluster FROM part",
    "v_wide": "SELECT vec_id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS _c{i}" for i in range(N_FEATURES))
    + f", CASE WHEN label >= 5 THEN 1 ELSE -1 END AS _c{N_FEATURES} FROM embeddings",
}


def sql(body: str, *views: str) -> str:
    """``body`` after a WITH of the named inputs, which may also be given as ``name AS (...)``."""
    items = [v if " AS (" in v else f"{v} AS ({SQL_VIEWS[v]})" for v in views]
    return f"WITH {', '.join(items)} {body}"
