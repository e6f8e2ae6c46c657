"""File sources. Every schema is explicit, so no reader scans its input twice to infer types."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnspark.sources.tables import materialise

RATINGS = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("item_id", T.IntegerType()),
        T.StructField("rating", T.DoubleType()),
    ]
)

TAG_SCORES = T.StructType(
    [
        T.StructField("item_id", T.IntegerType()),
        T.StructField("tag_id", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ]
)

TAG_NAMES = T.StructType(
    [
        T.StructField("tag_id", T.IntegerType()),
        T.StructField("tag", T.StringType()),
    ]
)


def read_log(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Log lines as ``value``, one row per line; compression follows from the file name.

    A gzip file cannot be split and arrives as one partition. Give ``partitions`` to spread its
    lines before the parsing work; leave it out for many files or splittable text.
    """
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool) -> DataFrame:
    # FAILFAST: a row that does not fit the declared schema stops the job instead of turning into NULLs.
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)


def read_ratings(spark: SparkSession, path: str, schema: T.StructType = RATINGS) -> DataFrame:
    """Ratings CSV with a header line. Columns are taken by position, names come from ``schema``.

    Further columns at the end of a line (a time stamp, say) are ignored unless ``schema`` lists
    them. That rules FAILFAST out, so a value of the wrong type reads as NULL: ``read_checked``
    keeps such lines apart.
    """
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def wide_schema(n_features: int, label_type: str = "int") -> T.StructType:
    """``_c0`` .. ``_c{n-1}`` double and the label ``_c{n}``."""
    columns = [f"_c{i} double" for i in range(n_features)] + [f"_c{n_features} {label_type}"]
    return T.StructType.fromDDL(", ".join(columns))


def read_wide(spark: SparkSession, path: str, n_features: int, label_type: str = "int") -> DataFrame:
    """Headerless numeric CSV: ``n_features`` feature columns, then the label."""
    return _read_csv(spark, path, wide_schema(n_features, label_type), header=False)


def read_tag_scores(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: (item, tag, score)."""
    return _read_csv(spark, path, TAG_SCORES, header=True)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: (tag id, tag name)."""
    return _read_csv(spark, path, TAG_NAMES, header=True)


class Checked(NamedTuple):
    rows: DataFrame  # the lines that fit the schema
    rejects: DataFrame  # line, file: the text of the others and the name of their file


def read_checked(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> Checked:
    """CSV lines that fit ``schema``, and those that do not, from one scan of the files.

    A line is rejected if a value is not of its column's type, or if it has fewer or more values than
    the first line of the files (the header, where there is one). Columns are taken by position, and
    further ones than ``schema`` names are ignored. An empty value is NULL and an empty line is no
    line. Both results read a table in shared storage, written once.
    """
    reader = spark.read.option("header", header)
    width = max(len(reader.csv(path).columns), len(schema))  # reads the first line
    bad, file = "_reject_line", "_reject_file"
    further = [T.StructField(f"_further_{i}", T.StringType()) for i in range(width - len(schema))]
    parsed = (
        reader.schema(T.StructType([*schema.fields, *further, T.StructField(bad, T.StringType())]))
        .option("enforceSchema", True)
        .option("columnNameOfCorruptRecord", bad)
        .option("columnPruning", False)  # a line is judged by all of its values
        .csv(path)
        .select("*", F.col("_metadata.file_name").alias(file))
    )
    # Two values: each task writes its own files, and no line travels.
    marked = parsed.select(*schema.names, bad, file, F.col(bad).isNotNull().alias("_rejected"))
    stored = materialise(marked, "checked", ["_rejected"], rebalance=False)
    return Checked(
        stored.where("not _rejected").select(*schema.names),
        stored.where("_rejected").select(F.col(bad).alias("line"), F.col(file).alias("file")),
    )
