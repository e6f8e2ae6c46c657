"""Parquet sink and intermediate tables in shared storage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# Py4J's thread that tells the JVM so sleeps a second at a time.
PYTHON_DROPS = 1.2

_local_roots: dict[str, str] = {}
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def _shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one temporary folder per application in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to storage that every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="cairnspark-")
    return _local_roots[context.applicationId]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Iterative estimators cut their lineage only where the context has a checkpoint folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_root(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder, or under that of the ``scratch`` block, that no other run uses."""
    return f"{_scratch.get() or _shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def release(spark: SparkSession, path: str) -> None:
    """Delete a table in shared storage; nothing happens if it is not there."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def release_unused(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and cached blocks of tables and models that nothing refers to any more.

    Spark does so after a garbage collection of the driver, which by itself may come only after half an hour.
    The driver's JVM learns what Python dropped only within ``PYTHON_DROPS`` seconds, so the call waits for that.
    """
    gc.collect()
    time.sleep(PYTHON_DROPS)
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside the block are deleted when it ends.

    The block must hold the last read of them: write what shall stay to a path chosen before it.
    Blocks may be nested; the setting does not pass to other threads.
    """
    path = fresh_path(spark, "scratch")
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)
        release(spark, path)


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    rebalance: bool = True,
    sort_by: Sequence[str] = (),
    compression: str | None = None,
) -> None:
    """Write Parquet, optionally one directory per value of ``partition_by``.

    With partition columns the rows are first rebalanced on them: each directory gets few files,
    and AQE splits a value that holds a large share of the rows over several tasks. Without
    ``rebalance`` nothing is shuffled, and each task writes a file for each of its values. ``sort_by`` orders the
    rows of each file. ``compression`` is the session's setting if not given.
    """
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path, compression=compression)


def materialise(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    path: str | None = None,
    rebalance: bool = True,
    sort_by: Sequence[str] = (),
    compression: str | None = None,
) -> DataFrame:
    """Write ``df`` once to shared storage (a fresh path, if none is given) and read it back.

    Used where several jobs read one result: the table survives lost executors, and the plan of
    the reader starts at the file instead of at the whole history. It stays until ``release``, or
    until the end of the ``scratch`` block around the call.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    write_parquet(df, path, partition_by, rebalance=rebalance, sort_by=sort_by, compression=compression)
    # Partition values are part of the directory name; the given schema keeps their types.
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
