"""Cuts of a plan's lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: Paths that the run at hand has made, where it keeps a list (``scratch``).
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; below a temporary folder where that is unset and Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="strandweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (mine := _made.get()) is not None:
        mine.append(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows doesn't depend on executors' local state.
    The folder is deleted when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    drop_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_on_exit(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that are over: it does once the driver has collected their garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_by(df: DataFrame, key: str, name: str = "cut") -> DataFrame:
    """Like ``cut``, bucketed by ``key``: joins on it read the written side in place, without a shuffle. The table and its folder go
    when the driver ends."""
    spark = df.sparkSession
    path, table = shared_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    drop_on_exit(spark, path)
    atexit.register(_drop, spark, table)
    return spark.table(table)


def _drop(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and an in-memory catalog with it
        if not spark.sparkContext._jsc.sc().isStopped():
            spark.sql(f"DROP TABLE IF EXISTS {table}")


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths made inside, in order; not those that other threads make meanwhile."""
    paths: list[str] = []
    token = _made.set(paths)
    try:
        yield paths
    finally:
        _made.reset(token)
        if (outer := _made.get()) is not None:
            outer.extend(paths)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete what nothing reads any more."""
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
