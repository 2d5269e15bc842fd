"""Runs that were found block by block, as whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_runs(runs: DataFrame, keys: list[str], *same: str) -> DataFrame:
    """keys, start, windows and ``same`` of maximal runs. Runs with ``edge``, which touch an edge of their block, meet by keys, and
    those that follow one another and agree in ``same`` become one; any other is a group of its own, dealt by its start as well."""
    alone = F.when(F.col("edge"), -1).otherwise(F.col("start"))
    runs = runs.select(*keys, "start", F.col("windows").cast("long").alias("windows"), *same, alone.alias("alone"))
    order = Window.partitionBy(*keys, "alone").orderBy("start")
    goes_on = F.lag(F.col("start") + F.col("windows")).over(order) == F.col("start")
    for c in same:
        goes_on = goes_on & (F.lag(c).over(order) == F.col(c))
    runs = runs.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    agg = [F.min("start").alias("start"), F.sum("windows").alias("windows"), *(F.first(c).alias(c) for c in same)]
    return runs.groupBy(*keys, "alone", "run").agg(*agg).drop("alone", "run")
