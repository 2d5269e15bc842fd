"""Enough partitions for all cores where an input has fewer."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew only if a scan gives fewer partitions than there are cores, as one small file does; windows are made
    per row, so this decides how many cores make them. Large inputs are left as they are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
